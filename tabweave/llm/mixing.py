"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.llm.common import free_names, keep, query, table

#: Words of a block; every source is cut into blocks of nearly this many.
BLOCK_WORDS = 1024
#: Slots that one window of the ranking holds at most.
SLOT_RUN = 1 << 16
#: Rows of a shuffled source that one window holds, about.
LINE_ROWS = 1 << 12
#: Low-discrepancy step: the fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
WORD = "[^\\x20\\x09-\\x0D]+"
#: Sources up to which their plan is broadcast.
MANY_SOURCES = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], repeats: float, budget: float | None = None) -> list[float]:
    """Share ``budget`` (default: all sizes) by weight, no source above ``repeats`` times its size.

    What a full source can't take is shared again among the others by weight until none is above.
    """
    left = float(sum(sizes) if budget is None else budget)
    out = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0]
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def source_plan(sized: DataFrame, weights: Sequence[float], repeats: float) -> list[dict]:
    """One entry a source, by code point with null last: its size, rows and target.  Bounded by the number of sources."""
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    wanted = targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], repeats)
    return [{"source": r["source"], "number": i, "size": int(r["size"]), "rows": r["rows"], "target": t} for i, (r, t) in enumerate(zip(found, wanted, strict=True))]


def _plan_frame(spark: SparkSession, plan: list[dict], block_words: int) -> DataFrame:
    """The plan with block widths: ``blocks`` blocks of ``width`` words a source (the last may be shorter), ``need`` slots."""
    rows = []
    for p in plan:
        width = max(1, -(-p["size"] // max(1, round(p["size"] / block_words))))
        blocks, wanted = -(-p["size"] // width), int(round(p["target"]))
        rounds, rest = divmod(wanted, p["size"]) if p["size"] else (0, 0)
        need = rounds * blocks + -(-rest // width)
        rows.append((p["source"], p["number"], p["size"], p["target"], wanted, width, blocks, need, max(1, -(-p["rows"] // LINE_ROWS))))
    kind = "source string, number int, source_size long, target double, wanted long, width long, blocks long, need long, runs long"
    return spark.createDataFrame(rows, kind)


def _small(df: DataFrame, n: int) -> DataFrame:
    """Broadcast a table of one row a source while there are few sources; beyond, Spark's own choice holds."""
    return F.broadcast(df) if n <= MANY_SOURCES else df


def schedule(spark: SparkSession, plan: list[dict], frame: DataFrame) -> DataFrame:
    """The mix as slots: slot, number (source), rank, block, words taken from the front of that block.

    Slot t maps the point frac((t + 1) * golden ratio) through the cumulative slot needs of
    the sources; the rank of a slot among its source's slots picks the block, going round the
    source's blocks.  A source stops at exactly its target: ranks beyond its need are passed
    over, its last block is cut, and the few ranks that the sequence leaves out close the mix.
    """
    needs = {r["number"]: r["need"] for r in frame.select("number", "need").collect()}
    length = sum(needs.values())
    if not length:
        return spark.createDataFrame([], "slot long, number int, rank long, block long, words long")
    edges, run = [], 0
    for p in plan[:-1]:
        run += needs[p["number"]]
        edges.append(run / length)
    point = F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0))
    which = F.array_size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= point)) if edges else F.lit(0)
    slots = spark.range(length).select(F.col("id").alias("slot"), which.cast("int").alias("number"), F.floor(F.col("id") / SLOT_RUN).alias("run"))
    per_run = slots.groupBy("run", "number").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_run.select("run", "number", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    local = Window.partitionBy("run", "number").orderBy("slot")
    ranked = slots.withColumn("at", F.row_number().over(local) - 1).join(offsets, ["run", "number"]).select("slot", "number", (F.col("before") + F.col("at")).alias("rank"))
    got = per_run.groupBy("number").agg(F.sum("n").alias("got"))
    short = frame.join(got, "number", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("need > got")
    rest = short.select("number", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank")).select((F.lit(length) + F.col("rank")).alias("slot"), "number", "rank")
    sized = _small(frame.select("number", "source_size", "wanted", "width", "blocks", "need"), len(plan))
    taken = ranked.unionByName(rest).join(sized, "number").filter("rank < need").withColumn("block", F.expr("rank % blocks"))
    begin = F.expr("(rank div blocks) * source_size + block * width")
    width = F.least(F.col("width"), F.expr("source_size - block * width"))
    return taken.select("slot", "number", "rank", "block", F.least(width, F.col("wanted") - begin).alias("words"))


def lines(sized: DataFrame, plan_frame: DataFrame, n_sources: int) -> DataFrame:
    """Every source's documents in shuffled order on one line of words: adds ``start``, the words before each.

    The order is by a hash; equal ranges of the hash are summed first and a window runs only
    inside a range, so a source with a third of all rows is spread over many windows.
    """
    lo = F.pmod(F.col("mix"), F.lit(1 << 30))
    plans = _small(plan_frame.select(F.col("source").alias("_source"), "number", "source_size", "target", "width", "runs"), n_sources)
    placed = sized.join(plans, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("run", F.floor(lo * F.col("runs") / F.lit(float(1 << 30))).cast("bigint"))
    per_run = placed.groupBy("number", "run").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_run.select("number", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    local = Window.partitionBy("number", "run").orderBy("mix", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("local", F.coalesce(F.sum("size").over(local), F.lit(0)))
    return inside.join(offsets, ["number", "run"]).withColumn("start", F.col("before") + F.col("local")).drop("before", "local", "run", "runs")


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), repeats: int = 3, block_words: int = BLOCK_WORDS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix: (documents with size, source_size, target, taken words and the slots they fill; parts in mix order).

    ``parts`` has slot, number, doc_id, row, from_word and words: which words of which
    document fill which place of the mix, slots in order.  Sizes are words; null
    texts have none and null sources form the last source.  Sources whose words are
    spent begin anew, up to ``repeats`` times.  Repeated rows are separate documents; the order
    depends on text, doc_id and seed alone, so reruns agree.  Empty tables give empty frames.
    """
    spark = docs.sparkSession
    sized = keep(
        docs.select(
            F.col("doc_id"), F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("mix"), F.monotonically_increasing_id().alias("row"),
        ),
        "mix-sizes",
    )
    plan = source_plan(sized, weights, repeats)
    frame = keep(_plan_frame(spark, plan, block_words), "mix-plan")
    lined = keep(lines(sized, frame, len(plan)), "mix-lines")
    slots = schedule(spark, plan, frame)
    last = F.expr("(start + size - 1) div width")
    spans = lined.filter("size > 0").select("*", F.explode(F.sequence(F.expr("start div width"), last)).alias("block")).select(
        "number", "block", "doc_id", "row", "start", (F.col("block") * F.col("width")).alias("first"),
        F.greatest(F.col("block") * F.col("width"), F.col("start")).alias("a"), F.least((F.col("block") + 1) * F.col("width"), F.col("start") + F.col("size")).alias("b"),
    )
    upto = F.least(F.col("b"), F.col("first") + F.col("words"))
    parts = spans.join(slots, ["number", "block"]).filter(upto > F.col("a")).select(
        "slot", "number", "doc_id", "row", (F.col("a") - F.col("start")).alias("from_word"), (upto - F.col("a")).alias("words"), (F.col("a") - F.col("first")).alias("place")
    )
    counted = parts.groupBy("row").agg(F.sum("words").alias("got"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    out = lined.join(counted, "row", "left").select(
        "doc_id", "source", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", F.coalesce("got", F.lit(0)).cast("bigint").alias("taken"), "row", "mix",
        F.col("first_slot").cast("bigint").alias("first_slot"), F.coalesce("n_slots", F.lit(0)).cast("bigint").alias("n_slots"),
    )
    return out, parts


def mixed_texts(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), repeats: int = 3, seed: int = 17) -> DataFrame:
    """The documents that the mix takes, with all their columns: one row for each time a document is taken.

    A source's line is taken from its front, so at most one document a source is taken in part: its
    last row has its first words only, and n_chars follows.  Rows that the mix doesn't reach, and rows
    without words, are not in it.  Repeated rows share what they are taken.
    """
    out, _ = mix_documents(docs.select("doc_id", "text", "source"), weights, repeats, seed=seed)
    mix, source, taken, size, same, key, turn, left = free_names(docs, "mix", "source", "taken", "size", "same", "key", "turn", "left")
    got = keep(
        out.filter("taken > 0").groupBy(F.col("mix").alias(mix), F.col("source").alias(source)).agg(F.sum("taken").alias(taken), F.first("size").alias(size), F.count(F.lit(1)).alias(same)), "taken"
    )
    keyed = docs.withColumn(key, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")))
    joined = keyed.join(got, (F.col(key) == F.col(mix)) & F.col("source").cast("string").eqNullSafe(F.col(source)))
    once = joined.filter(F.col(same) == 1).unionByName(joined.filter(F.col(same) > 1).dropDuplicates([key, source]))
    turns = once.withColumn(turn, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(taken) - 1) / F.col(size)))))
    rows = turns.withColumn(left, F.least(F.col(size), F.col(taken) - F.col(turn) * F.col(size)))
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, n in zip(b.column("text").to_pylist(), b.column(left).to_pylist(), strict=True):
                texts.append(text[: next(islice(re.finditer(WORD, text), n - 1, None)).end()])
            got = {c: b.column(c) for c in columns} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(got.values()), names=list(got))

    part = rows.filter(F.col(left) < F.col(size)).select(*columns, left).mapInArrow(cut, docs.schema)
    if "n_chars" in columns:
        part = part.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return rows.filter(F.col(left) == F.col(size)).select(*columns).unionByName(part)


@query("op10_low_discrepancy_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mix_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")
