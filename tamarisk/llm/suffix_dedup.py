"""Exact removal of repeated strings over a corpus by sharded suffix arrays.

Every start of a string of ``length`` bytes has an anchor: the smallest hash of the grams
inside that string.  Equal strings have equal anchors, so all of them meet in one shard.
Neighbouring starts with one anchor are one fragment of text.

What moves, in order: equal texts become one class by a grouped minimum; blocks of texts
name their anchors, five bytes each and an anchor at most twice a block, and hear which
of them are named twice; only fragments of those become rows, and anchors of one document
drop out; where all
fragments of an anchor are equal they are one class; the others go, each distinct fragment
once, to shards.  A shard builds a suffix array by induced sorting and permuted common
prefixes; suffixes with a common prefix of ``length`` bytes are one class, which tells each
start the smallest document that has its string.  Anchors with more than
``group_fragments`` distinct fragments are dealt by single strings, so none fills a task.
"""

from __future__ import annotations

import gc
import hashlib
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.skew import join_statistics
from tamarisk.llm.suffix_sorting import permuted_prefixes, suffix_array
from tamarisk.llm.textbytes import Chunk, chunks, gram_hashes, mix, prefix_hash, signed, span_hash
from tamarisk.operators.lineage import written

_FRAGMENT = 64  # starts of one fragment at most; longer runs of one anchor are several fragments
_NAME = 5  # bytes of an anchor's name; anchors with one name are told apart later, by their hashes
_LOW = np.uint64(64 - 8 * _NAME)
_CHUNK = 1 << 17  # bytes hashed at once, few enough that the arrays stay in a core's cache
_LONG = 16  # a text so many times longer than the mean is a block of its own


@dataclass(frozen=True)
class RepeatParams:
    """Bytes of a repeated string, bytes of a gram, bounds of a group and of a shard's array,
    bytes of text in a block and of those that one bucket of anchor names stands for."""

    length: int = 50
    gram: int = 24
    group_fragments: int = 8192
    array_bytes: int = 1 << 20
    block_bytes: int = 1 << 21
    bucket_bytes: int = 1 << 25


def anchors(chunk: Chunk, p: RepeatParams):
    """Fragments of a chunk: text, first start, number of starts, anchor, hash of the fragment."""
    n, none = len(chunk.data), np.empty(0, dtype=np.int64)
    if n < p.length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(chunk.data)
    low = gram_hashes(prefix, p.gram)
    width, have = p.length - p.gram + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    long_ = np.flatnonzero(np.diff(chunk.offsets) >= p.length)
    if not len(long_):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    begin, end = chunk.offsets[long_], chunk.offsets[long_ + 1] - p.length + 1
    edge = np.zeros(n + 1, dtype=bool)
    np.not_equal(low[1:], low[:-1], out=edge[1 : len(low)])
    edge[begin] = edge[end] = True
    run = np.flatnonzero(edge)
    of = np.searchsorted(begin, run, side="right") - 1
    inside = np.flatnonzero((of >= 0) & (run < end[of]))
    starts, size, of = run[inside], run[inside + 1] - run[inside], of[inside]
    pieces = -(-size // _FRAGMENT)
    past = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _FRAGMENT
    at = np.repeat(starts, pieces) + past
    span = np.minimum(np.repeat(size, pieces) - past, _FRAGMENT)
    text = long_[np.repeat(of, pieces)]
    return text, at - chunk.offsets[text], span, low[at], span_hash(prefix, at, at + span - 1 + p.length)


def _names(h: np.ndarray) -> np.ndarray:
    """Names of anchors, evenly spread: the upper bytes of the mixed hash."""
    return mix(h) >> _LOW


def _packed(names: np.ndarray) -> bytes:
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_NAME].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // _NAME, 8), dtype=np.uint8)
    wide[:, :_NAME] = np.frombuffer(data, dtype=np.uint8).reshape(-1, _NAME)
    return wide.view("<u8").ravel()


_OCC = "doc_id long, v long, h long, f long, at long, span int"
_NAMED = "bucket int, block long, names binary"


def _named(p: RepeatParams, buckets: int):
    """Per block and bucket: the names of the anchors, twice where two texts have them."""
    edges = np.array([(i << 8 * _NAME) // buckets for i in range(1, buckets)], dtype=np.uint64)

    def told(block, held):
        name = np.unique(np.concatenate(held)) >> _LOW
        more = np.ones(len(name), dtype=bool)
        more[2:] = name[2:] != name[:-2]
        name = name[more]
        cut = np.concatenate(([0], np.searchsorted(name, edges), [len(name)]))
        at = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(np.full(len(at), block), pa.int64()),
             pa.array([_packed(name[cut[i] : cut[i + 1]]) for i in at], pa.binary())], ["bucket", "block", "names"])

    def run(batches):
        block, held, texts, size = None, [], 0, 0
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1), _CHUNK):
                text, _, _, h, _ = anchors(chunk, p)
                if not len(text):
                    continue
                of = blocks[chunk.rows.start + text]
                first = np.append(0, np.flatnonzero(np.diff(of)) + 1)
                for i, j in zip(first, np.append(first[1:], len(of)), strict=True):
                    if held and (of[i] != block or size > p.block_bytes or texts + len(chunk) >> int(_LOW)):
                        yield told(block, held)
                        held, texts, size = [], 0, 0
                    block = of[i]
                    held.append(_names(h[i:j]) << _LOW | (text[i:j] + texts).astype(np.uint64))
                    size += int(j - i)
                texts += len(chunk)
        if held:
            yield told(block, held)

    return run


def _shared_names(table: pa.Table) -> pa.Table:
    """Of a bucket: the names that stand there more than once, for each block that has them."""
    lists = table.column("names").to_pylist()
    end = np.cumsum([len(x) // _NAME for x in lists])
    every = _unpacked(b"".join(lists))
    ordered = np.sort(every)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    at = np.searchsorted(twice, every)
    met = np.append(twice, ~np.uint64(0))[at] == every
    out = [_packed(x[y]) for x, y in zip(np.split(every, end[:-1]), np.split(met, end[:-1]), strict=True)]
    found = pa.table([table.column("block"), pa.array(out, pa.binary())], ["block", "names"])
    return found.filter(pa.array([len(x) > 0 for x in out]))


def _occurring(p: RepeatParams):
    """Fragments of a block whose anchors are among the names it heard."""
    types = (("doc_id", pa.int64()), ("v", pa.int64()), ("h", pa.int64()), ("f", pa.int64()), ("at", pa.int64()),
             ("span", pa.int32()))
    schema = pa.schema(types)

    def run(texts: pa.Table, heard: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows and heard.num_rows:
            known = np.sort(_unpacked(b"".join(heard.column("names").to_pylist())))
            doc, v = (texts.column(c).to_numpy() for c in ("doc_id", "v"))
            for chunk in chunks(texts.column("text"), _CHUNK):
                text, at, span, h, f = anchors(chunk, p)
                name = _names(h)
                met = known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name
                row = chunk.rows.start + text[met]
                out.append(pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, (_, t) in
                     zip((doc[row], v[row], signed(h[met]), signed(f[met]), at[met], span[met]), types, strict=True)],
                    schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def _cut_out(p: RepeatParams):
    """Texts of the fragments that each row lists."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            asked = lists.flatten()
            at, span = (asked.field(x).to_numpy() for x in ("at", "span"))
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            texts = [x.encode() for x in batch.column(1).to_pylist()]
            frags = [texts[i][a:b] for i, a, b in zip(row.tolist(), at.tolist(), (at + span - 1 + p.length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(asked.field(x) for x in ("h", "f", "many")), batch.column(0).take(pa.array(row)), pa.array(frags, pa.binary())],
                ["h", "f", "many", "least", "frag"])

    return run


def _held(frags: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column, one text after the other, and the length of each."""
    size = pc.binary_length(frags).to_numpy().astype(np.int64)
    return np.frombuffer(b"".join(frags.to_pylist()), dtype=np.uint8), size


def smallest_owners(data: np.ndarray, size: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For each start of a string of ``length`` bytes, fragment by fragment: the smallest
    ``least`` of all fragments that hold the string."""
    end = np.cumsum(size + 1) - 1
    s = np.zeros(end[-1] + 1, dtype=np.int64)
    body = np.ones(len(s), dtype=bool)
    body[end] = False
    s[body] = data.astype(np.int64) + 1
    frag_of = np.repeat(np.arange(len(size)), size + 1)
    left = end[frag_of] - np.arange(len(s))
    sa = suffix_array(s, 257)
    common = permuted_prefixes(s, sa)[sa]
    full = left[sa] >= length
    sa, fresh = sa[full], (common < length)[full]
    fresh[:1] = True
    least_of = np.minimum.reduceat(least[frag_of[sa]], np.flatnonzero(fresh))
    owner = np.zeros(len(s), dtype=np.int64)
    owner[sa] = least_of[np.cumsum(fresh) - 1]
    return owner[left >= length]


def _met(data: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Whether a fragment may share a string with another one: a string's hash is there twice.

    The lower bits of a hash give way to the string's number; what is found too often is sorted.
    """
    starts = size - length + 1
    frag_of = np.repeat(np.arange(len(size)), starts)
    start = np.arange(len(frag_of)) + frag_of * (length - 1)
    bits = np.uint64(len(start).bit_length())
    hashes = span_hash(prefix_hash(data), start, start + length) >> bits << bits
    ordered = np.sort(hashes | np.arange(len(start), dtype=np.uint64))
    same = ordered[1:] >> bits == ordered[:-1] >> bits
    order = (ordered & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    out = np.zeros(len(size), dtype=bool)
    out[frag_of[order[1:][same]]] = True
    out[frag_of[order[:-1][same]]] = True
    return out


_RUN = "array<struct<from_:int,to_:int,owner:long>>"


def _sorted_shards(p: RepeatParams):
    schema = pa.schema([("h", pa.int64()), ("f", pa.int64()), ("runs", pa.list_(pa.struct(
        [("from_", pa.int32()), ("to_", pa.int32()), ("owner", pa.int64())])))])

    def solved(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        h, f, least, frags = (table.column(k).combine_chunks() for k in range(4))
        data, size = _held(frags)
        # a fragment whose strings stand nowhere else in the shard has no neighbour to be sorted with
        met = _met(data, size, p.length)
        starts, least = size - p.length + 1, least.to_numpy()
        owner = np.repeat(least, starts)
        if met.any():
            owner[np.repeat(met, starts)] = smallest_owners(*_held(frags.filter(pa.array(met))), least[met], p.length)
        first = np.cumsum(starts) - starts
        edge = np.append(True, owner[1:] != owner[:-1])
        edge[first] = True
        at = np.flatnonzero(edge)
        to = np.append(at[1:], len(owner))
        runs = np.searchsorted(at, np.append(first, len(owner)))
        begin = np.repeat(first, np.diff(runs))
        told = pa.StructArray.from_arrays(
            [pa.array(at - begin, pa.int32()), pa.array(to - begin, pa.int32()), pa.array(owner[at], pa.int64())],
            ["from_", "to_", "owner"])
        return pa.RecordBatch.from_arrays([h, f, pa.ListArray.from_arrays(pa.array(runs, pa.int32()), told).cast(schema.field(2).type)], schema=schema)

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            h = batch.column(0).to_numpy()
            fresh = np.flatnonzero(np.append(last is None or h[0] != last, h[1:] != h[:-1]))
            total = np.append(0, np.cumsum(pc.binary_length(batch.column(3)).to_numpy().astype(np.int64) + 1))
            last, at = h[-1], 0
            while True:
                # a shard ends before the first anchor that finds it full
                full = max(at, int(np.searchsorted(total, total[at] + p.array_bytes - size, side="right")))
                ends = fresh[np.searchsorted(fresh, full) :]
                if not len(ends):
                    break
                held.append(batch.slice(at, ends[0] - at))
                yield solved(held)
                held, size, at = [], 0, int(ends[0])
            held.append(batch.slice(at))
            size += int(total[-1] - total[at])
        if held:
            yield solved(held)

    return run


def _removed(p: RepeatParams):
    def run(batches):
        for batch in batches:
            out = []
            for i in range(len(batch)):
                data = np.frombuffer(batch.column(2)[i].as_py().encode(), dtype=np.uint8)
                step = np.zeros(len(data) + 1, dtype=np.int64)
                marks = batch.column(3)[i].values
                a = marks.field("a").to_numpy()
                b = marks.field("b").to_numpy()
                np.add.at(step, a, 1)
                np.add.at(step, b - 1 + p.length, -1)
                gone = np.cumsum(step[:-1]) > 0
                spans = int(np.count_nonzero(np.diff(np.append(0, gone.astype(np.int8))) == 1))
                left = data[~gone].tobytes()
                out.append((int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([r[k] for r in out], t) for k, t in
                 enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary())))],
                ["doc_id", "digest", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _step(df: DataFrame, name: str) -> DataFrame:
    """The written table of a step.

    Spark deletes the shuffle files of a step when the driver's collector finds its plan
    unused; without a hint that may come after the next steps have filled the disks.
    """
    out, jvm = written(df, name), df.sparkSession.sparkContext._jvm
    del df
    for _ in range(3):  # what holds a plan goes first, then the plan, then its files
        gc.collect()
        jvm.System.gc()
        time.sleep(0.3)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False,
                   params: RepeatParams = RepeatParams()) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for.

    A byte goes when a string of ``length`` bytes over it also starts in a row with a
    smaller id.  Null and empty texts have 0 bytes.  Rows with one id do not remove each
    other's bytes; rows with a null id remove nothing and lose nothing.  Other columns are
    not looked at.
    """
    p = params
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("digest", F.md5(F.col("text").cast("binary")))
    base = _step(
        texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"),
                     F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "repeat-base")
    first = base.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("n"))
    placed = _step(join_statistics(base, first, "digest", "n", base.count()).drop("n"), "repeat-placed")
    # one row per distinct text; v tells apart texts that share an id, and is 0 where an id has one
    one = placed.where(f"doc_id = head and n_bytes >= {p.length}").select("doc_id", "digest").distinct()
    per_id = one.groupBy("doc_id").agg(F.count("*").alias("n"))
    number = join_statistics(one, per_id, "doc_id", "n", one.count()).select(
        "doc_id", "digest", F.when(F.col("n") > 1, F.xxhash64("digest")).otherwise(0).alias("v")
    )
    heads = _step(
        texts.join(number.hint("merge"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
        .select("doc_id", "v", "digest", "text", F.monotonically_increasing_id().alias("row")),
        "repeat-heads")

    # rows that were written one after the other are a block
    n, size = heads.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    mean = size // max(n, 1)
    together = min(max(p.block_bytes // max(mean, 1), 1).bit_length() - 1, 20)
    alone = F.octet_length("text") > _LONG * mean
    blocks = heads.select("doc_id", "v", "text", F.when(alone, -F.col("row") - 1).otherwise(
        F.shiftright("row", together)).alias("block"))
    heard = _step(
        blocks.select("block", "text").mapInArrow(_named(p, size // p.bucket_bytes + 1), _NAMED)
        .groupBy("bucket").applyInArrow(_shared_names, "block long, names binary"), "repeat-names")
    occurrences = _step(
        blocks.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(_occurring(p), _OCC), "repeat-occurrences")

    shared = _step(
        occurrences.groupBy("h").agg(
            F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("f").alias("f0"),
            F.max("f").alias("f1"), F.count("*").alias("n"))
        .where("least < most").select("h", "least", (F.col("f0") == F.col("f1")).alias("same"), "n"), "repeat-anchors")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    live = _step(
        join_statistics(occurrences, shared, "h", "n", total).where("not same or doc_id > least")
        .drop("n"), "repeat-live")
    equal = live.where("same").select("doc_id", "v", F.struct(F.col("at").alias("a"), (F.col("at") + F.col("span")).alias("b")).alias("m"))

    mixed = live.where("not same").select("doc_id", "v", "h", "f", "at", "span")
    reps = _step(
        mixed.groupBy("h", "f").agg(F.min(F.struct("doc_id", "v", "at", "span")).alias("x"), F.count("*").alias("n")),
        "repeat-fragments")
    crowd = reps.groupBy("h").agg(F.count("*").alias("fragments")).where(F.col("fragments") > p.group_fragments)
    asked = (
        reps.join(crowd.hint("merge"), "h", "left")
        .select("x.doc_id", "x.v", F.struct("h", "f", "x.at", "x.span", F.col("fragments").isNotNull().alias("many")).alias("y"))
        .groupBy("doc_id", "v").agg(F.collect_list("y").alias("ys"))
    )
    frags = _step(
        heads.join(asked.hint("merge"), ["doc_id", "v"]).select("doc_id", "text", "ys")
        .mapInArrow(_cut_out(p), "h long, f long, many boolean, least long, frag binary"), "repeat-texts")
    few = (
        frags.where("not many").select("h", "f", "least", "frag").repartition("h").sortWithinPartitions("h", "f")
        .mapInArrow(_sorted_shards(p), f"h long, f long, runs {_RUN}")
    )
    # crowded anchors: every string of the length on its own
    string = frags.where("many").select(
        "h", "f", "least", "frag", F.explode(F.sequence(F.lit(0), F.octet_length("frag") - p.length)).alias("o")
    ).select("h", "f", "least", "o", F.substring("frag", F.col("o") + 1, F.lit(p.length)).alias("w"))
    owners = string.groupBy("w").agg(F.min("least").alias("owner"), F.count("*").alias("c"))
    several = string.agg(F.count("*")).first()[0]
    many = join_statistics(string, owners, "w", "c", several).groupBy("h", "f").agg(
        F.collect_list(F.struct(F.col("o").alias("from_"), (F.col("o") + 1).alias("to_"), "owner")).cast(_RUN).alias("runs"))
    told = _step(few.unionByName(many), "repeat-owners")
    key = F.struct("h", "f").alias("hf")
    stats = told.join(reps.select("h", "f", "n"), ["h", "f"]).select(key, "runs", "n")
    met = join_statistics(mixed.select("doc_id", "v", "at", key), stats, "hf", "n", mixed.count())
    unequal = met.select("doc_id", "v", "at", F.explode("runs").alias("r")).where("doc_id > r.owner").select(
        "doc_id", "v", F.struct((F.col("at") + F.col("r.from_")).alias("a"), (F.col("at") + F.col("r.to_")).alias("b")).alias("m"))
    marks = _step(equal.unionByName(unequal).groupBy("doc_id", "v").agg(F.collect_list("m").alias("ms")), "repeat-marks")
    cut = heads.join(marks.hint("merge"), ["doc_id", "v"]).select("doc_id", "digest", "text", "ms").mapInArrow(
        _removed(p), "doc_id long, digest string, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if not with_kept:
        cut = cut.drop("kept")
    cut = cut.withColumnsRenamed({"n_removed": "cut_bytes", "n_spans": "cut_spans", "kept_sha256": "cut_sha"})
    copy = (F.col("doc_id") > F.col("head")) & (F.col("n_bytes") >= p.length)
    out = placed.join(cut, ["doc_id", "digest"], "left").select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("cut_bytes", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("cut_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, hashlib.sha256().hexdigest()).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), "digest"] if with_kept else []),
    )
    if not with_kept:
        return out
    # rows that lose nothing keep their text
    whole = texts.select("doc_id", "digest", F.col("text").cast("binary").alias("whole")).where("doc_id is not null")
    whole = whole.dropDuplicates(["doc_id", "digest"])
    nulls = texts.where("doc_id is null").select("digest", F.col("text").cast("binary").alias("plain")).dropDuplicates(["digest"])
    return (
        out.join(whole, ["doc_id", "digest"], "left").join(nulls, "digest", "left")
        .withColumn("kept", F.coalesce("kept", "whole", "plain")).drop("whole", "plain", "digest")
    )
