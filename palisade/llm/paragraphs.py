"""Substring dedup: paragraphs that come again in other documents.

Near paragraphs. A paragraph is what stands between newlines; those of at least ``least`` words
(``MIN_WORDS``: shorter ones are headings, stock phrases and list items, which clean texts share) are
reduced to a set of 5-word shingles and a MinHash of ``BANDS`` x ``ROWS`` values. Paragraphs
that agree in a band are joined and verified by exact Jaccard (0.75 or more): a pair at the
threshold meets in some band with a chance of 99.6 %. Colliding pairs are first held against a
lower bound of their difference: where the parities of two sets, counted over ``64 * PARITIES``
buckets, differ, at least one shingle is in one set only; so pairs with more differing buckets than
the threshold allows are out, exactly, before any set is fetched. As in the n-gram join, every paragraph of a
band group is first held against the most frequent one and its neighbour, then all those of
different classes against each other, so that no colliding pair is left out and large groups take
linear work. Components of the links are the clusters; in each, the paragraphs of the first
document (least id) stay and those of later documents go.

Passages. The words of a whole text, newlines ignored, are looked at in every run of
``PASSAGE`` words; a run that an earlier document has goes, wherever its lines and sentences end, and
runs that overlap or touch are one span. So every equal passage of at least ``PASSAGE`` words is
found to its full length. To compare so many runs, each gets an *anchor*: of the 26 runs of
``ANCHOR`` words inside it, the one with the least hash (neighbours mostly have the same one). Equal
runs have equal anchors; so only runs whose anchor came in more than one document (by a bit filter,
which may let others through) are compared, by 64-bit hash. A run that meets a paragraph cut as a
near copy is not what stays of a passage.

Repeats inside one document are left alone. Texts are never shuffled by the search; paragraphs,
anchors and the runs of shared anchors are, as hashes. Null or empty texts have no paragraphs. A document is an id with a
text: equal rows count as one, rows of one id with different texts as several, in order of a hash of the
text; rows without an id come last of all. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm import blocks
from palisade.llm.batches import byte_texts, slices
from palisade.llm.components import components
from palisade.llm.jaccard import crossing_pairs, homes, nearest_pairs, node_of, same_length, shared_prefixes, verified
from palisade.llm.store import private, release, saved, text_key
from palisade.llm.words import SHINGLE, distinct, hashed_lines, hashed_texts, mixed, windows

MIN_WORDS = 25
#: Words of a passage that goes whatever its layout, and of the runs from which its anchors are taken.
PASSAGE, ANCHOR = 50, 25
BANDS, ROWS = 10, 3
NO_ID = (1 << 63) - 1
LATER = "(doc > first OR row <> first_row)"
#: Words of 64 bits in which a paragraph's bucket parities are kept.
PARITIES = 8
PARITY = [f"parity{k}" for k in range(PARITIES)]
_RANDOM = np.random.default_rng(20240229)
FACTORS = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
UNIT = "doc long, row long, paragraph int, start int, end int, n_words int, hash long, n int, bands array<long>, " + ", ".join(
    f"{c} long" for c in PARITY
)


def lines(text: str) -> Iterator[tuple[int, str]]:
    """(start, paragraph) in code points."""
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def line_sets(hashes: np.ndarray, sizes: np.ndarray, least: int = MIN_WORDS) -> Iterator[np.ndarray | None]:
    """Shingle set of each line; none for one of fewer than ``least`` words."""
    shingles = windows(hashes, SHINGLE)
    at = 0
    for n in sizes.tolist():
        yield distinct(shingles[at : at + n - SHINGLE + 1]) if n >= max(least, SHINGLE) else None
        at += n


def paragraph_sets(texts: list[bytes], least: int = MIN_WORDS) -> list[np.ndarray]:
    """Shingle sets of the paragraphs of at least ``least`` words."""
    return [s for hashes, sizes in hashed_lines(texts) for s in line_sets(hashes, sizes, least) if s is not None]


def joined_runs(values: np.ndarray, step: int, times: int) -> np.ndarray:
    """Hash of every ``times`` neighbouring runs of ``step`` words each, of which ``values`` has the hashes."""
    value = np.full(max(len(values) - step * (times - 1), 0), times, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(times):
            value = value * np.uint64(0x9E3779B97F4A7C15) + values[k * step : k * step + len(value)]
    return mixed(value)


def anchor_runs(hashes: np.ndarray) -> np.ndarray:
    return joined_runs(windows(hashes, SHINGLE), SHINGLE, ANCHOR // SHINGLE)


def anchors(runs: np.ndarray) -> np.ndarray:
    """For each run of ``PASSAGE`` words the place of its anchor, the least of the runs inside it."""
    width = PASSAGE - ANCHOR + 1
    if len(runs) < width:
        return np.zeros(0, dtype=np.int64)
    least = np.lib.stride_tricks.sliding_window_view(runs, width).argmin(axis=1)
    return least + np.arange(len(least))


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, line) of each word; starts and ends in code points."""
    raw = np.frombuffer(text, np.uint8)
    blank = ((raw == 32) | ((raw >= 9) & (raw <= 13))).astype(np.int8)
    edges = np.diff(blank, prepend=1, append=1)
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points[starts], points[ends], np.cumsum(raw == 10)[starts]


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Whether each bucket of hashes holds an odd number of a set's shingles, as bits: a row for each set."""
    size = 64 * PARITIES
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = (np.concatenate(sets) & np.uint64(size - 1)).astype(np.int64)
    odd = np.bincount(owner * size + bucket, minlength=len(sets) * size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sets), PARITIES)


def may_repeat(one: str, two: str) -> Column:
    """Length filter, and as few differing parities as 4 * intersection >= 3 * union allows."""
    differ = sum((F.bit_count(F.col(f"{one}.{c}").bitwiseXOR(F.col(f"{two}.{c}"))) for c in PARITY), F.lit(0))
    return same_length(one, two) & (7 * differ <= F.col(f"{one}.n") + F.col(f"{two}.n"))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """The band values of each set: a row for each set. All sets are taken function by function."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    least = np.empty((len(sets), BANDS * ROWS), dtype=np.uint64)
    value = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), 1))
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            least[:, k] = np.minimum.reduceat(flat * FACTORS[k] + SHIFTS[k], starts)
        for k in range(ROWS):
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + least[:, k::ROWS])
    return value.view(np.int64)


def units(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Paragraphs (hash: their node) and anchors (hash only) of each text.

    What hangs on a paragraph's words alone (n: shingles, bands, parities) is given with the first
    copy in a task and is null with the others.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            out: list[tuple] = []
            new: list[np.ndarray] = []
            hashed = hashed_lines(byte_texts(batch.column(2)))
            for doc, row, text, (own, sizes) in zip(*(c.to_pylist() for c in batch.columns), hashed):
                for p, ((at, line), n, s) in enumerate(zip(lines(text or ""), sizes.tolist(), line_sets(own, sizes, least))):
                    if s is not None:
                        node = node_of(s)
                        out.append((doc, row, p, at, at + len(line), n, node, None if node in seen else len(new)))
                        if node not in seen:
                            seen.add(node)
                            new.append(s)
            if out:
                *told, place = zip(*out)
                place = pa.array(place, pa.int64())
                columns = [pa.array(c, f.type) for c, f in zip(told, FIELDS)]
                if new:
                    banded = pa.ListArray.from_arrays(np.arange(len(new) + 1, dtype=np.int32) * BANDS, pa.array(bands(new).ravel()))
                    known = [pa.array([len(s) for s in new], pa.int32()), banded, *map(pa.array, np.ascontiguousarray(parities(new).T))]
                    columns += [c.take(place) for c in known]
                columns += [pa.nulls(len(out), f.type) for f in list(FIELDS)[len(columns):]]
                yield pa.RecordBatch.from_arrays(columns, schema=FIELDS)
            yield anchor_rows(batch, [hashes for hashes, _ in hashed])

    return keyed(docs).mapInArrow(cut, UNIT)


def anchor_rows(batch: pa.RecordBatch, words: list[np.ndarray]) -> pa.RecordBatch:
    """The anchors of each text, of which ``words`` has the word hashes; each anchor once."""
    found = [distinct(runs[np.unique(anchors(runs))]) for runs in map(anchor_runs, words)]
    docs, rows = (np.repeat(batch.column(k).to_numpy(), [len(f) for f in found]) for k in (0, 1))
    hashes = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
    given = {"doc": pa.array(docs), "row": pa.array(rows), "hash": pa.array(hashes)}
    columns = [given.get(f.name, pa.nulls(len(docs), f.type)) for f in FIELDS]
    return pa.RecordBatch.from_arrays(columns, schema=FIELDS)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, row, text): id and hash of the text together name a document."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_key().alias("row"), "text")


def in_many(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows of groups that lie in more than one document, with the ``first`` and ``first_row`` of these."""
    ends = [f(c).alias(f"{c}_{k}") for c in ("doc", "row") for k, f in (("lo", F.min), ("hi", F.max))]
    groups = rows.groupBy(*keys).agg(*ends).where("doc_lo <> doc_hi OR row_lo <> row_hi")
    met = rows.join(groups.select(*keys, F.col("doc_lo").alias("first")), [*keys])
    least = met.where("doc = first").groupBy(*keys).agg(F.min("row").alias("first_row"))
    return met.join(least, [*keys])


def plausible(pairs: DataFrame, parity: DataFrame) -> DataFrame:
    """The ``pairs`` that pass the parity bound."""
    columns = [F.struct("n", *PARITY).alias(c) for c in "xy"]
    one, two = (parity.select(F.col("node").alias(k), c) for k, c in zip("ab", columns))
    return saved(pairs.join(one, "a").join(two, "b").where(may_repeat("x", "y")).select("a", "b"))


def paragraph_classes(docs: DataFrame, paragraphs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(node, root) of the paragraphs that have a near one."""
    nodes = saved(
        paragraphs.groupBy(F.col("hash").alias("node")).agg(
            (-F.count("*")).alias("rank"), F.max("n").alias("n"), F.max("bands").alias("bands"),
            *(F.max(c).alias(c) for c in PARITY),
        )
    )
    parity = nodes.select("node", "n", *PARITY)
    banded = nodes.select(F.explode("bands").alias("shingle"), "node", "n", F.lit(0).alias("place"), "rank")
    shared = saved(shared_prefixes(banded))
    release()
    sets = partial(paragraph_sets, least=least)
    home = homes(paragraphs.select(F.col("hash").alias("node"), "row"))
    near = saved(nearest_pairs(shared, ("rank", "n"), same_length))
    hopeful = plausible(near, parity)
    links = verified(hopeful, docs, home, sets)
    met = crossing_pairs(shared, components(links), may_repeat, lambda rows: rows.join(parity.drop("n"), "node"))
    crossing = saved(met.join(near, ["a", "b"], "left_anti"))
    release(nodes, shared, near, hopeful, met)
    return components(links.union(verified(crossing, docs, home, sets)))


def repeated_paragraphs(docs: DataFrame, paragraphs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Paragraph rows of clusters that lie in more than one document, with ``first`` of them."""
    classes = paragraph_classes(docs, paragraphs, least)
    labelled = saved(
        paragraphs.drop("n", "bands", *PARITY).join(classes.withColumnRenamed("node", "hash"), "hash", "left")
        .withColumn("root", F.coalesce("root", "hash"))
    )
    return in_many(labelled, "root").select("doc", "row", "paragraph", "start", "end", "n_words", "first", "first_row")


def passage_runs(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Per text the runs of ``PASSAGE`` words whose anchor is in ``bits``: lists of ``RUN_LISTS``."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in slices(batches):
            texts = byte_texts(batch.column(2))
            out: list[tuple] = []
            for doc, row, text, hashes in zip(*(c.to_pylist() for c in batch.columns[:2]), texts, hashed_texts(texts)):
                runs = anchor_runs(hashes)
                at = np.flatnonzero(blocks.passing(wanted, runs[anchors(runs)].view(np.int64)))
                if len(at):
                    starts, ends, line = word_places(text)
                    last = at + PASSAGE - 1
                    whole = joined_runs(runs, ANCHOR, PASSAGE // ANCHOR)[at].view(np.int64)
                    out.append((doc, row, at, starts[at], ends[last], line[at], line[last], whole))
            if out:
                doc, row, *lists = zip(*out)
                stops = pa.array(np.cumsum([0, *map(len, lists[0])]), pa.int32())
                flat = [pa.array(np.concatenate(c)).cast(RUN_LISTS.field(k).type) for k, c in enumerate(lists)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(row, pa.int64()), *(pa.ListArray.from_arrays(stops, c) for c in flat)],
                    ["doc", "row", *RUN_LISTS.names],
                )

    lists = ", ".join(f"{f.name} array<{'long' if f.type == pa.int64() else 'int'}>" for f in RUN_LISTS)
    return keyed(docs).mapInArrow(search, f"doc long, row long, {lists}")


def told_runs(found: DataFrame) -> DataFrame:
    """Runs of ``found`` (``passage_runs`` with the ``lost`` paragraphs of their texts), one by one.

    What lies whole in paragraphs that go needs no second cut and is left out; a run ``stands`` if
    it meets none of them.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner = np.repeat(np.arange(batch.num_rows), batch.column("at").value_lengths().to_numpy())
            lists = {name: batch.column(name).flatten().to_numpy() for name in RUN_LISTS.names}
            lost = batch.column("lost")
            times = lost.value_lengths().fill_null(0).to_numpy()
            gone = np.sort((np.repeat(np.arange(batch.num_rows), times) << 32) + lost.flatten().to_numpy())
            place = owner << 32
            n_lost = np.searchsorted(gone, place + lists["last_line"], "right") - np.searchsorted(gone, place + lists["line"])
            left = np.flatnonzero(n_lost < lists["last_line"] - lists["line"] + 1)
            owner = owner[left]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(batch.column(c).to_numpy()[owner]) for c in ("doc", "row")),
                    *(pa.array(lists[c][left]) for c in ("at", "start", "end", "line", "hash")),
                    pa.array(n_lost[left] == 0),
                ],
                ["doc", "row", "at", "start", "end", "line", "hash", "stands"],
            )

    return found.mapInArrow(tell, RUN)


def repeated_passages(docs: DataFrame, shared: DataFrame, gone: DataFrame) -> DataFrame:
    """Spans (doc, row, paragraph, start, end, n_words, first) of words that earlier documents have too.

    ``shared`` has the anchors (hash) of more than one document, ``gone`` the paragraphs (doc, row,
    paragraph) that are cut as near copies.
    """
    lost = gone.groupBy("doc", "row").agg(F.collect_list("paragraph").alias("lost"))
    # merged, not broadcast, however few: both passes in one stage would take two workers for each task
    marked = passage_runs(docs, blocks.bit_filter(shared)).join(lost.hint("merge"), ["doc", "row"], "left")
    rows = saved(told_runs(marked))
    release(shared)
    groups = rows.groupBy("hash").agg(
        F.min(F.when(F.col("stands"), F.col("doc"))).alias("first"), F.max("doc").alias("last"),
        F.min("row").alias("row_lo"), F.max("row").alias("row_hi"),
    )
    # a run that does not stand may come before the first that does: it is not cut for a later one
    first = saved(groups.where("last > first OR (last = first AND row_lo <> row_hi)").select("hash", "first"))
    release()
    met = saved(rows.join(first, "hash").where("doc >= first"))
    release(rows, first)
    # one id may have several texts: those behind the least of them are later too
    texts = met.where("doc = first").groupBy("hash").agg(
        F.min(F.when(F.col("stands"), F.col("row"))).alias("first_row"), F.max("row").alias("last_row")
    )
    tied = texts.where("last_row > first_row").select("hash", "first_row")
    behind = met.where("doc = first").join(tied, "hash").where("row > first_row").select(met.columns)
    later = saved(met.where("doc > first").union(behind).select("doc", "row", "at", "start", "end", "line", "first"))
    release(met)
    along = Window.partitionBy("doc", "row").orderBy("at")
    new = F.coalesce(F.col("at") - F.lag("at").over(along) > PASSAGE, F.lit(True)).cast("int")
    runs = later.withColumn("new", new).withColumn("island", F.sum("new").over(along))
    return (
        runs.groupBy("doc", "row", "island")
        .agg(
            F.min("line").alias("paragraph"), F.min("start").alias("start"), F.max("end").alias("end"),
            (F.max("at") - F.min("at") + PASSAGE).cast("int").alias("n_words"), F.min("first").alias("first"),
        )
        .drop("island")
    )


def shared_anchors(anchor: DataFrame) -> DataFrame:
    """(hash) of the anchors that lie in more than one document."""
    ends = [f(c).alias(f"{c}_{k}") for c in ("doc", "row") for k, f in (("lo", F.min), ("hi", F.max))]
    return saved(anchor.groupBy("hash").agg(*ends).where("doc_lo <> doc_hi OR row_lo <> row_hi").select("hash"))


def repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, paragraph, start, end, n_words, first_doc_id, kind, removed, row) of repeated passages.

    ``removed`` is false for the paragraphs of a cluster's first document. Spans are in code points.
    ``row`` is the ``text_key`` of the text in which the span lies. Paragraphs of fewer than
    ``least`` words (``SHINGLE`` at least) are not compared as paragraphs.
    """
    found = saved(units(docs, least))
    paragraphs = found.where("paragraph IS NOT NULL")
    near = saved(repeated_paragraphs(docs, paragraphs, least))
    gone = near.where(LATER).select("doc", "row", "paragraph").distinct()
    shared = shared_anchors(found.where("paragraph IS NULL").select("doc", "row", "hash"))
    release(found)
    passages = repeated_passages(docs, shared, gone)
    key = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    columns = [
        key("doc").alias("doc_id"), "paragraph", "start", "end", "n_words", key("first").alias("first_doc_id"),
    ]
    return near.select(*columns, F.lit("paragraph").alias("kind"), F.expr(LATER).alias("removed"), "row").union(
        passages.select(*columns, F.lit("passage").alias("kind"), F.lit(True).alias("removed"), "row")
    )


def cut_text(text: str | None, spans: list | None) -> str | None:
    if not spans:  # Spark calls the function before it looks at the condition
        return text
    merged: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    pieces, at, last = [], 0, "\n"
    for start, end in merged:
        pieces.append(text[at:start])
        last = text[start - 1] if start > at else last
        # a cut that takes whole lines takes the end of the last of them along
        at = end + 1 if last == "\n" and text[end : end + 1] == "\n" else end
    left = "".join(pieces) + text[at:]
    return left.removesuffix("\n") if merged[-1][1] == len(text) and last == "\n" else left


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with removed spans cut out; documents of which no word is left are left out.

    Nothing outside the spans is changed, but that a cut of whole lines takes one line end along.

    ``n_chars``, where there is one, is counted anew for texts that were cut.
    """
    cut_id, cut_row, cut_spans = private("id", "row", "spans")
    spans = (
        found.where("removed")
        .groupBy(F.col("doc_id").alias(cut_id), F.col("row").alias(cut_row))
        .agg(F.collect_set(F.struct("start", "end")).alias(cut_spans))
    )
    same = F.col("doc_id").eqNullSafe(F.col(cut_id)) & (text_key() == F.col(cut_row))
    joined = docs.join(spans, same, "left")
    # the test for words would else be pushed below the cut, and all texts cut twice, by two workers for each task
    cut = F.udf(cut_text, "string", useArrow=True).asNondeterministic()
    whole = F.col(cut_spans).isNull()
    text = F.when(whole, F.col("text")).otherwise(cut("text", cut_spans))
    edited = joined.withColumn("text", text).where(whole | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        n = F.when(whole, F.col("n_chars")).otherwise(F.length("text"))
        edited = edited.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return edited.select(docs.columns)


FIELDS = pa.schema(
    [
        ("doc", pa.int64()), ("row", pa.int64()), ("paragraph", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
        ("n_words", pa.int32()), ("hash", pa.int64()), ("n", pa.int32()), ("bands", pa.list_(pa.int64())),
        *((c, pa.int64()) for c in PARITY),
    ]
)
RUN_LISTS = pa.schema(
    [
        ("at", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
        ("line", pa.int32()), ("last_line", pa.int32()), ("hash", pa.int64()),
    ]
)
RUN = "doc long, row long, at int, start int, end int, line int, hash long, stands boolean"
