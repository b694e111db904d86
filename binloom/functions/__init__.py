"""Column functions: sequences, vectors, rules. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def sequence(text: Column) -> Column:
    """A sequence as the k-mer operators take it: upper case, unknown bases (N) as A; other codes stay and their k-mers are ignored."""
    return F.translate(F.upper(text), "N", "A")


def clean_sequence(text: Column) -> Column:
    """Only the bases of a text, upper case; for texts that stand in for sequences. Sequences go through ``sequence``."""
    return F.regexp_replace(F.upper(text), "[^ACGT]", "")


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of a sequence in order; none if it is shorter than k."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """``a`` at length one; a null vector as it is."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x)))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(normalised(a), normalised(b))


def min_max(a: Column) -> Column:
    """``a`` stretched to [0, 1]; null where all values are equal."""
    return F.transform(a, lambda x: F.when(F.array_max(a) > F.array_min(a), (x - F.array_min(a)) / (F.array_max(a) - F.array_min(a))))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def quality_state(comp: Column, cont: Column) -> Column:
    return F.when((comp >= 90) & (cont <= 5), "high").when((comp >= 50) & (cont <= 10), "medium").otherwise("low")


def quality_score(comp: Column, cont: Column, bonus: bool = True) -> Column:
    plain = comp - 4 * cont
    return plain + F.when(quality_state(comp, cont) == "high", 100).when(quality_state(comp, cont) == "medium", 50).otherwise(0) if bonus else plain


def grid_score(comp: Column, cont: Column) -> Column:
    """120 more for high, 50 more for medium, nothing for low."""
    state = quality_state(comp, cont)
    return F.when(state == "high", comp - 4 * cont + 120).when(state == "medium", comp - 4 * cont + 50).otherwise(0.0)


def edge_weight(d2: Column, bandwidth: float, squared: bool = True) -> Column:
    return F.exp(-(d2 if squared else F.sqrt(d2)) / bandwidth)


def length_weight(length: Column, shortest: int) -> Column:
    return F.ln(length) / F.ln(F.lit(float(shortest)))


def temperature(n50: Column, n_contigs: Column, large: int) -> Column:
    """Contrastive temperature from N50 and the number of contigs."""
    is_large = n_contigs >= large
    between = F.round(-0.000002 * n50 + 0.155, 3) - F.when(is_large, 0.01).otherwise(0.0)
    return F.when(n50 >= 15000, F.when(is_large, 0.115).otherwise(0.125)).when(n50 <= 5000, F.when(is_large, 0.135).otherwise(0.145)).otherwise(between)


def softmax(logits: Column) -> Column:
    """Shares of an array of log weights, shifted by the greatest."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda s, y: s + y))


def temperature_schedule(temp: Column, epochs: int) -> Column:
    """One temperature an epoch: a line from 0.005 below to 0.005 above, in thousandths; the last is the end itself."""
    line = F.transform(F.sequence(F.lit(0), F.lit(epochs - 2)), lambda i: F.round(temp - 0.005 + i * (0.01 / epochs), 3)) if epochs > 1 else F.array().cast("array<double>")
    return F.concat(line, F.array(temp + 0.005))


def learning_rate(epoch: Column, base: float, multiplier: float, warm: int, rest: int) -> Column:
    """Linear warm-up to ``multiplier`` times the base, then cosine arcs of half the remaining epochs each."""
    arc = -(-rest // 2)
    return F.when(epoch <= warm, base * ((multiplier - 1) * epoch / warm + 1)).otherwise(base * multiplier / 2 * (1 + F.cos(F.pmod(epoch - warm, F.lit(arc)) * (math.pi / arc))))


def epochs(n50: Column, n_contigs: Column, base: int, large: int = 153600, most: int = 200) -> Column:
    """Training epochs: four more for long contigs, and more in proportion where there are few contigs."""
    of = F.when(n50 >= 1536, F.lit(base + 4)).otherwise(F.lit(base)).cast("long")
    return F.least(F.lit(most).cast("long"), F.when(n_contigs >= large, of).otherwise(F.floor(of * large / n_contigs)))


def coding_table(density4: Column, density11: Column) -> Column:
    """The genetic code whose genes fit: 4 if they cover clearly more than those of 11, and most of the sequence."""
    return F.when((density4 - density11 > 0.05) & (density4 > 0.7), 4).otherwise(11)


def sample_ok(seq: Column, shortest: int) -> Column:
    """Whether a sampled sequence is used: long enough, and at most a fifth of it unknown."""
    return (F.length(seq) >= shortest) & (F.regexp_count(seq, F.lit("N")) <= 0.2 * F.length(seq))


# --- random choices, reproducible: numbers in (0, 1) that follow from a key


def uniform(*key: Column | str | int) -> Column:
    text = F.concat_ws(":", *[(F.lit(str(k)) if isinstance(k, (str, int)) else k.cast("string")) for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(*key: Column | str | int) -> Column:
    return F.sqrt(-2 * F.ln(uniform(*key, "r"))) * F.cos(2 * math.pi * uniform(*key, "a"))


def gumbel(*key: Column | str | int) -> Column:
    """The largest of logits + gumbel is a draw by their softmax."""
    return -F.ln(-F.ln(uniform(*key)))


def view(seq: Column, shortest: int, key: Column) -> Column:
    """seq, start, end of a random part of a sequence, at least ``shortest`` - 1 long."""
    n = F.length(seq)
    size = F.least(n, F.lit(shortest - 1) + F.floor(uniform(key, "size") * (n - shortest + 2)).cast("int"))
    return F.transform(F.array(F.greatest(F.lit(0), size)), lambda m: F.transform(F.array(F.floor(uniform(key, "start") * (n - m + 1)).cast("int")), lambda s: F.struct(F.substring(seq, s + 1, m).alias("seq"), s.alias("start"), (s + m).alias("end")))[0])[0]


def _places(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.sequence(F.lit(1), F.length(seq))).otherwise(F.array().cast("array<int>"))


def _other_base(base: Column, u: Column) -> Column:
    """One of the other three bases; of all four for another letter."""
    three = F.replace(F.lit("TCGA"), base, F.lit(""))
    return F.substring(three, (F.floor(u * F.length(three)) + 1).cast("int"), F.lit(1))


def substituted(seq: Column, key: Column, ratio: float) -> Column:
    """``seq`` with each base changed to another with chance ``ratio``."""
    each = lambda i: F.transform(F.array(F.substring(seq, i, F.lit(1))), lambda c: F.when(uniform(key, i, "hit") >= ratio, c).otherwise(_other_base(c, uniform(key, i, "base"))))[0]
    return F.array_join(F.transform(_places(seq), each), "")


def inserted(seq: Column, key: Column, ratio: float, scatter: bool = False) -> Column:
    """``seq`` with random bases put in: after each base with chance ``ratio``, or in one place int(n * ratio) + 1 of them."""
    if scatter:
        each = lambda i: F.transform(F.array(F.substring(seq, i, F.lit(1))), lambda c: F.when(uniform(key, i, "hit") >= ratio, c).otherwise(F.concat(c, _other_base(c, uniform(key, i, "base")))))[0]
        return F.array_join(F.transform(_places(seq), each), "")
    n = F.length(seq)
    noise = F.array_join(F.transform(F.sequence(F.lit(1), (F.floor(n * ratio) + 1).cast("int")), lambda i: F.substring(F.lit("ATCG"), (F.floor(uniform(key, i, "base") * 4) + 1).cast("int"), F.lit(1))), "")
    at = (F.floor(uniform(key, "at") * F.greatest(n - 1, F.lit(1))) + 1).cast("int")
    return F.concat(F.substring(seq, F.lit(1), at), noise, F.substring(seq, at + 1, n))


def deleted(seq: Column, key: Column, ratio: float, scatter: bool = False) -> Column:
    """``seq`` without some bases: each dropped with chance ``ratio``, or int(n * ratio) + 1 of them in one place."""
    if scatter:
        return F.array_join(F.transform(F.filter(_places(seq), lambda i: uniform(key, i, "hit") >= ratio), lambda i: F.substring(seq, i, F.lit(1))), "")
    n = F.length(seq)
    size = (F.floor(n * ratio) + 1).cast("int")
    at = (F.floor(uniform(key, "at") * F.greatest(n - 1 - size, F.lit(1))) + 1).cast("int")
    return F.concat(F.substring(seq, F.lit(1), at), F.substring(seq, at + size + 1, n))


def augmented(seq: Column, key: Column, ratio: float = 0.005) -> Column:
    """One of the simulators by chance, a third each; insertions and deletions scattered or in one place by halves."""
    u, half = uniform(key, "kind"), uniform(key, "scatter") <= 0.5
    return F.when(u <= 0.333, substituted(seq, key, ratio)).when(u <= 0.666, F.when(half, deleted(seq, key, ratio, True)).otherwise(deleted(seq, key, ratio))).otherwise(F.when(half, inserted(seq, key, ratio, True)).otherwise(inserted(seq, key, ratio)))


def dropped_out(values: Column, key: Column, chance: float) -> Column:
    """``values`` with each one zeroed with a chance."""
    return F.transform(values, lambda x, i: F.when(uniform(key, i, "drop") > chance, x).otherwise(F.lit(0.0)))


def jittered(values: Column, key: Column, scale: float) -> Column:
    """``values`` with normal noise, none below zero."""
    return F.transform(values, lambda x, i: F.greatest(F.lit(0.0), x + scale * normal(key, i)))


def vmf_log_density(cosine: Column, kappa: Column, dim: int) -> Column:
    """Log density of a von Mises-Fisher distribution in more than 50 dimensions, by the asymptotic normaliser."""
    nu = dim / 2 - 1

    def s(k: Column, alpha: float, beta: float) -> Column:
        root = F.sqrt(k * k + beta * beta)
        return root - beta - (alpha * F.ln((alpha + root) / (alpha + beta)) if alpha else F.lit(0.0))

    low = F.least(kappa, F.lit(math.sqrt((3 * nu + 5.5) * (nu + 1.5))))
    return kappa * cosine - (s(kappa, nu + 0.5, nu + 0.5) + s(low, nu, nu + 2) - s(low, nu + 0.5, nu + 0.5))
