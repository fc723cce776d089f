"""Vector and probability operators over rows of arrays, in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, pos (from 0), x."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(vector).alias("pos", "v")).select("id", "pos", F.col("v").cast("double").alias("x"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def softmax(v: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits, shifted by its maximum."""

    def share(e: Column) -> Column:
        return _let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total))

    def powers(d: Column) -> Column:
        return _let(F.array_max(d), lambda top: _let(F.transform(d, lambda x: F.exp(x - top)), share))

    return _let(F.transform(v, lambda x: x.cast("double") / temperature), powers)


def repetition_penalty(logits: DataFrame, seen: Column, penalty: float) -> DataFrame:
    """exploded logits with those of seen tokens made less likely."""
    less = F.when(F.col("x") > 0, F.col("x") / penalty).otherwise(F.col("x") * penalty)
    return logits.withColumn("y", F.when(seen, less).otherwise(F.col("x")))


def top_k(probs: DataFrame, k: int) -> DataFrame:
    """The k most likely tokens of each row, all that tie with the last."""
    return probs.withColumn("posto", F.rank().over(Window.partitionBy("id").orderBy(F.col("p").desc()))).filter(F.col("posto") <= k)


def top_p(probs: DataFrame, share: float) -> DataFrame:
    """The most likely tokens up to the one that reaches the share."""
    w = Window.partitionBy("id").orderBy(F.col("p").desc(), "pos").rowsBetween(Window.unboundedPreceding, 0)
    return probs.withColumn("massa", F.sum("p").over(w)).filter(F.col("massa") - F.col("p") < share)


def sampling_chain(logits: Column, seen: Column, forbidden: Column, penalty: float = 1.1, temperature: float = 0.8, k: int = 10, share: float = 0.95) -> Column:
    """Array of (p, pos) a token is drawn from, most likely first: forbidden tokens out, seen ones (arrays of positions) made less
    likely, softmax, the k most likely and their ties, of these the ones up to the share, renormalised. One expression on the row."""
    less = F.transform(
        logits,
        lambda x, i: F.when(F.array_contains(forbidden, i), F.lit(-1e9)).otherwise(
            F.when(F.array_contains(seen, i), F.when(x > 0, x.cast("double") / penalty).otherwise(x.cast("double") * penalty)).otherwise(x.cast("double"))
        ),
    )
    pairs = F.transform(softmax(less, temperature), lambda p, i: F.struct((-F.round(p, 9)).alias("minus"), i.alias("pos")))

    def cut(ordered: Column) -> Column:
        top = F.filter(ordered, lambda x: x.minus <= F.get(ordered, F.least(F.lit(k), F.size(ordered)) - 1).minus)
        start = F.struct(F.lit(0.0).alias("mass"), F.array().cast("array<struct<minus:double,pos:int>>").alias("kept"))
        step = lambda a, x: F.struct((a.mass - x.minus).alias("mass"), F.when(F.round(a.mass, 9) < share, F.array_append(a.kept, x)).otherwise(a.kept).alias("kept"))
        return F.aggregate(top, start, step).kept

    def whole(kept: Column) -> Column:
        return _let(F.aggregate(kept, F.lit(0.0), lambda s, x: s - x.minus), lambda total: F.transform(kept, lambda x: F.struct((-x.minus / total).alias("p"), x.pos.alias("pos"))))

    return _let(F.array_sort(pairs), lambda ordered: _let(cut(ordered), whole))


def draw(kept: Column, seed: Column) -> Column:
    """The position drawn from a sampling chain by a number made of seed; the same seed draws the same one."""
    u = F.pmod(F.xxhash64(seed), F.lit(1 << 30)) / float(1 << 30)
    walk = F.aggregate(kept, F.struct(F.lit(0.0).alias("mass"), F.lit(-1).alias("pos")), lambda a, x: F.struct((a.mass + x.p).alias("mass"), F.when(a.mass <= u, x.pos).otherwise(a.pos).alias("pos")))
    return walk.pos


def beam_search(starts: DataFrame, step: Callable[[DataFrame], DataFrame], width: int = 4, most: int = 50, end: int = 3, alpha: float = 0.6) -> DataFrame:
    """id, tokens, score: the best sequence for each row of starts(id, tokens array<int>), the new tokens only.

    step gives for frame(id, beam, tokens, loss) a row (beam, token, p) for each next token of each beam. Of each id the `width`
    most likely beams go on; ended ones wait for the end, where the score is the log likelihood over ((5 + n) / 6) ** alpha.
    """
    from lavra.session import materialize

    first = starts.select("id", F.lit("").alias("beam"), "tokens", F.size("tokens").alias("given"), F.lit(0.0).alias("loss"))
    open_, done = materialize(first, "beams"), first.limit(0)
    best = Window.partitionBy("id").orderBy(F.col("loss").desc(), "beam")
    for _ in range(most):
        asked = open_.withColumn("beam", F.concat_ws(".", "id", "beam"))
        more = asked.join(step(asked.select("id", "beam", "tokens", "loss")), "beam")
        more = more.select("id", F.concat_ws(".", F.substring_index("beam", ".", -1), F.lpad("token", 9, "0")).alias("beam"), F.array_append("tokens", F.col("token").cast("int")).alias("tokens"), "given", (F.col("loss") + F.log(F.col("p") + 1e-10)).alias("loss"))
        kept = more.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= width)
        kept = materialize(kept.withColumn("beam", F.lpad(F.col("r").cast("string"), 9, "0")).drop("r"), "beams")
        ended = F.element_at("tokens", -1) == end
        done, open_ = done.unionByName(kept.filter(ended)), kept.filter(~ended)
        if open_.isEmpty():
            break
    n = F.size("tokens") - F.col("given")
    scored = done.unionByName(open_).withColumn("score", F.col("loss") / F.when(n > 0, F.pow((5 + n) / F.lit(6.0), F.lit(alpha))).otherwise(1.0))
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), "tokens")
    return scored.withColumn("r", F.row_number().over(order)).filter("r = 1").select("id", F.expr("slice(tokens, given + 1, size(tokens))").alias("tokens"), "score")


def layer_norm_array(v: Column, eps: float = 1e-5) -> Column:
    """An array normalised to mean 0 and deviation 1."""

    def scaled(mean: Column) -> Column:
        d = F.transform(v, lambda x: x.cast("double") - mean)
        return _let(d, lambda d: _let(F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x) / F.size(d) + eps), lambda by: F.transform(d, lambda x: x / by)))

    return _let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(v), scaled)


def layer_norm(df: DataFrame, eps: float = 1e-5) -> DataFrame:
    """exploded rows normalised to mean 0 and deviation 1."""
    w = Window.partitionBy("id")
    return df.withColumn("y", (F.col("x") - F.avg("x").over(w)) / F.sqrt(F.var_pop("x").over(w) + eps))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def cross_entropy(p: Column) -> Column:
    return -F.log(p + 1e-9)


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(F.avg(loss), F.lit(20.0)))


def positional_encoding(positions: DataFrame, dim: int) -> DataFrame:
    """pos, i, valor of the sinusoidal table for frame(pos)."""
    each = positions.select("pos", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("i"))
    angle = F.col("pos") / F.pow(F.lit(10000.0), (2 * F.floor(F.col("i") / 2)) / F.lit(float(dim)))
    return each.withColumn("valor", F.when(F.col("i") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)))


def causal_attention(df: DataFrame, seq: str, pos: str, vector: str, dim: int) -> DataFrame:
    """seq, q, k, peso: softmax of scaled dot products of each position with those up to it, within sequences of bounded length."""
    a = df.select(F.col(seq).alias("seq"), F.col(pos).alias("q"), F.col(vector).alias("vq"))
    b = df.select(F.col(seq).alias("seq"), F.col(pos).alias("k"), F.col(vector).alias("vk"))
    score = a.join(b, (a.seq == b.seq) & (b.k <= a.q)).select(a.seq.alias("seq"), "q", "k", (dot(F.col("vq"), F.col("vk")) / float(dim) ** 0.5).alias("s"))
    w = Window.partitionBy("seq", "q")
    e = F.exp(F.col("s") - F.max("s").over(w))
    return score.withColumn("e", e).withColumn("peso", F.col("e") / (F.sum("e").over(w) + 1e-9)).select("seq", "q", "k", "peso")
