"""N-gram Jaccard self-join as a blocked sparse matrix product.

The product of the document by n-gram incidence matrix with its transpose holds all overlap counts.  Three
size-derived bounds keep it small without losing a pair:

* a document of n n-grams can only link if fewer than n - ceil(t n) + 1 of them are its own alone; merged
  count-min sketches (``sketch.py``) bound from above how many documents hold each;
* with n-grams in one global order, rarest first, linked documents share one of their first
  n - ceil(t n) + 1; documents that share such an n-gram, however remotely, form a class, and a class that fits a tile is one tile;
* a larger class is cut up by the n-grams that hold it together: documents of an n-gram that few hold are paired one by one,
  within the bound on sizes, and each pair goes to a tile of one document and its partners; documents of n-grams that many hold form
  classes of their own, whose tiles meet in pairs.  So a chain of documents that only neighbours link stays as long as it is;
* in a tile the product runs over blocks of columns; after each block, pairs
  whose count and remaining columns can't reach t (a + b) / (1 + t) are discarded.

Exact copies of a set are one row of the matrix.  A tile returns a spanning forest of its links
and each document's number of links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmem.llm import sketch
from graphmem.llm import textarrays as ta
from graphmem.llm.shared import connected_components, discard, written

BYTES_PER_WORD = 4
BATCH_BYTES = 2 << 20
#: Documents of a tile, n-grams of a tile, and columns of a block.
TILE_DOCS, TILE_KEYS, BLOCK_COLUMNS = 384, 500_000, 4096
#: In a class of several tiles, the documents of an n-gram that so many hold at most are paired one by one.
LIGHT = 32
#: Parts that the documents of an n-gram are counted in, so that one that very many hold isn't one task.
SALTS = 64
SETS = "doc_id long, row_key long, n_shingles long, set_high long, set_low long"
ROWS = "doc_id long, copies long, n long, tokens array<long>, keys binary"
LINKS = "a long, b long, degree long"


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct shingles of each text, sorted by text and value; words are ASCII-lower-cased."""
    data, offs = ta.utf8(column)
    starts, ends, bounds = ta.words(data, offs)
    hashes = ta.span_hashes(ta.ASCII_LOWER[data], starts, ends)
    first, text = ta.window_starts(bounds, size)
    keys = ta.window_hashes(hashes, size, ta.WINDOW_BASES[0])[first] if len(first) else np.zeros(0, np.uint64)
    count = np.diff(bounds)
    for n in range(1, size):  # texts of fewer words are one shingle
        short = np.flatnonzero(count == n)
        if len(short):
            whole = ta.window_hashes(hashes, n, ta.WINDOW_BASES[0])[bounds[:-1][short]]
            keys, text = np.concatenate((keys, ta.mix(whole + np.uint64(n)))), np.concatenate((text, short))
    return *ta.per_text_distinct(keys, text), len(count)


def _set_table(ids: pa.Array, row_keys: pa.Array, column: pa.Array, size: int) -> pa.RecordBatch:
    keys, text, n = shingles(column, size)
    at = np.searchsorted(text, np.arange(n + 1))
    halves = []
    for salt in (0, 0x9E3779B97F4A7C15):
        before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ta.mix(keys ^ np.uint64(salt)), dtype=np.uint64)))
        halves.append((before[at[1:]] - before[at[:-1]]).view(np.int64))
    return pa.RecordBatch.from_arrays([ids, row_keys, pa.array(np.diff(at), pa.int64()), *(pa.array(h, pa.int64()) for h in halves)], names=["doc_id", "row_key", "n_shingles", "set_high", "set_low"])


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, a hash of id and text, the size of the document's set, and 128 bits that tell its set from others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").fill_null("")
            for lo, hi in ta.pieces(ta.utf8(column)[1], BATCH_BYTES):
                yield _set_table(batch.column("doc_id").slice(lo, hi - lo), batch.column("row_key").slice(lo, hi - lo), column.slice(lo, hi - lo), size)

    return docs.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("row_key"), "text").mapInArrow(run, SETS)


def _chosen(table: pa.Table, reps: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A row for each representative, found by its key, and how many copies it stands for."""
    order = np.argsort(keys := reps.column("row_key").to_numpy(), kind="stable")
    keys, copies = keys[order], reps.column("copies").to_numpy()[order]
    if not len(keys) or not table.num_rows:
        return table.slice(0, 0), np.zeros(0, np.int64)
    mine, first = np.unique(table.column("row_key").to_numpy(), return_index=True)
    at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
    hit = keys[at] == mine
    return table.take(pa.array(first[hit])), copies[at[hit]]


def _group_shingles(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    column = table.column("text").combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not table.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    return shingles(column, size)


def _rows(table: pa.Table, copies: np.ndarray, layout: sketch.Layout, answers: pa.Table, size: int, percent: int) -> pa.Table:
    keys, text, docs = _group_shingles(table, size)
    n = np.bincount(text, minlength=docs)
    rarity = sketch.estimates(layout, keys, answers) if len(keys) else np.zeros(0, np.uint8)
    order = np.lexsort((keys, rarity, text))
    rank = np.arange(len(keys)) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
    first = n - -(-percent * n // 100) + 1
    token = (rank < first[text]) & (rarity[order] >= 2)  # text is sorted, and order keeps it so
    tokens, owner = keys[order][token].view(np.int64), text[token]
    count = np.bincount(owner, minlength=docs)
    some = np.flatnonzero(count)
    at = np.concatenate(([0], np.cumsum(n)))
    packed = [ta.pack(keys[at[i] : at[i + 1]]) for i in some]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count[some]))), pa.int32()), pa.array(tokens, pa.int64()))
    return pa.table({"doc_id": table.column("doc_id").take(pa.array(some)), "copies": pa.array(copies[some], pa.int64()), "n": pa.array(n[some], pa.int64()), "tokens": lists, "keys": pa.array(packed, pa.binary())})


def product(keys: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which documents of ``left`` link with which of ``right`` (row numbers into ``keys``)."""
    n = np.array([len(k) for k in keys])
    a, b = n[left][:, None], n[right][None, :]
    need = -(-percent * (a + b) // (100 + percent))
    active = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    columns, column = np.unique(np.concatenate(keys), return_inverse=True)
    owner = np.repeat(np.arange(len(keys)), n)
    shared = np.bincount(column, minlength=len(columns)) >= 2
    column, owner = (np.cumsum(shared) - 1)[column[shared[column]]], owner[shared[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    rest = np.bincount(owner, minlength=len(keys))
    counts = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, int(shared.sum()), BLOCK_COLUMNS):
        if not (active := active & (counts + np.minimum(rest[left][:, None], rest[right][None, :]) >= need)).any():
            break
        s = slice(*np.searchsorted(column, (lo, lo + BLOCK_COLUMNS)))
        block = np.zeros((len(keys), BLOCK_COLUMNS), np.float32)
        block[owner[s], column[s] - lo] = 1
        counts += (block[left] @ block[right].T).astype(np.int64)
        rest = rest - np.bincount(owner[s], minlength=len(keys))
    return active & (counts >= need)


def _tile(key: tuple, table: pa.Table, percent: int) -> pa.Table:
    """Forest edges of the links between two tiles (or inside one), and degrees."""
    i, j = key[1].as_py(), key[2].as_py()
    keys = [ta.unpack(x) for x in table.column("keys").to_pylist()]
    ids, copies, tile = (table.column(c).to_numpy() for c in ("doc_id", "copies", "tile"))
    left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    if not len(left) or not len(right):
        return _links([], [], [], [])
    links = product(keys, left, right, percent)
    if i == j:
        np.fill_diagonal(links, False)
    degree = np.zeros(len(ids), np.int64)
    np.add.at(degree, left, links @ copies[right])
    if i != j:
        np.add.at(degree, right, links.T @ copies[left])
    x, y = np.nonzero(links)
    x, y = left[x], right[y]
    label = np.arange(len(ids))
    while len(x):
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(ids)))
    some = np.flatnonzero(degree)
    return _links(ids[moved], ids[label[moved]], ids[some], degree[some])


def _links(a, b, doc, degree) -> pa.Table:
    none = pa.nulls
    return pa.table({
        "a": pa.concat_arrays([pa.array(a, pa.int64()), pa.array(doc, pa.int64())]),
        "b": pa.concat_arrays([pa.array(b, pa.int64()), none(len(doc), pa.int64())]),
        "degree": pa.concat_arrays([none(len(a), pa.int64()), pa.array(degree, pa.int64())]),
    })


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of each row.

    Two documents link if ``100 * intersection >= percent * union`` of their sets of distinct ``size``-word
    shingles; a text of fewer words is one shingle, a null text or one without words has none and links
    with nothing.  ``component_id``: the smallest id that links reach, the document's own included; ``n_links``: how
    many documents it links with, exact copies counted.  All links are found.

    Ids must be whole numbers, or text that reads as one.  Rows of equal id are one node of the graph; an empty table gives no rows.  A row without an id links with nothing and its ``component_id`` is null.
    Other columns are not read.  ``percent`` is from 1 to 100.
    """
    doc = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = written(shingle_sets(doc, size), "sets")
    kind = ["n_shingles", "set_high", "set_low"]
    classes = sets.where("n_shingles > 0 and doc_id is not null").groupBy(*kind).agg(F.min(F.struct("doc_id", "row_key")).alias("least"), F.count("*").alias("copies"))
    classes = written(classes.select(*kind, F.col("least.doc_id").alias("rep"), F.col("least.row_key").alias("row_key"), "copies"), "classes")

    layout = sketch.Layout(doc, "text", BYTES_PER_WORD)
    dealt = layout.dealt(doc, "doc_id", "text")
    reps = classes.select("row_key", "copies", layout.group(F.col("row_key")).alias("grp"))

    def sketched(table: pa.Table, chosen: pa.Table) -> pa.Table:
        own, _ = _chosen(table, chosen)
        keys = _group_shingles(own, size)[0]
        return sketch.send(layout, table.column("grp")[0].as_py() if table.num_rows else -1, keys)

    def rows(table: pa.Table, replies: pa.Table) -> pa.Table:
        chosen = replies.filter(pc.is_valid(replies.column("copies")))
        answers = replies.filter(pc.is_null(replies.column("copies")))
        own, copies = _chosen(table, chosen)
        return _rows(own, copies, layout, answers, size, percent)

    answers = sketch.merged(dealt.groupBy("grp").cogroup(reps.groupBy("grp")).applyInArrow(sketched, sketch.SENT))
    replies = answers.select("grp", "block", "totals", F.lit(None).cast("long").alias("row_key"), F.lit(None).cast("long").alias("copies")).unionByName(
        reps.select("grp", F.lit(None).cast("int").alias("block"), F.lit(None).cast("array<binary>").alias("totals"), "row_key", "copies")
    )
    matrix = written(dealt.groupBy("grp").cogroup(replies.groupBy("grp")).applyInArrow(rows, ROWS), "matrix")
    tiled, scratch = _tiles(matrix, percent)
    # Dealt anew: a large class has many pairs of tiles.
    key = ["component", "i", "j", "salt"]
    links = written(tiled.repartition(*key).groupBy(*key).applyInArrow(lambda key, table: _tile(key, table, percent), LINKS), "links")

    joined = connected_components(links.where("b is not null"))
    degrees = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("degree").alias("degree"))
    known = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(degrees, "rep", "left")
    known = known.select(*[F.col(c).alias(f"of_{c}") for c in kind], F.coalesce("component", "rep").alias("component"), (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("links"))
    same = [sets[c] == known[f"of_{c}"] for c in kind]
    out = sets.join(known, [*same, sets["doc_id"].isNotNull()], "left")
    out = written(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links")), "joined")
    for df in (sets, classes, matrix, links, joined, *scratch):
        discard(df)
    return out


def _tiles(matrix: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of the tiles to multiply, ``component, i, j, salt, doc_id, copies, tile, keys``, and the scratch tables they are read from."""
    tokens = matrix.select("doc_id", F.explode("tokens").alias("token")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = tokens.groupBy("token", "part").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    heads = parts.groupBy("token").agg(F.min("first").alias("head"), F.sum("n").alias("holders")).where("holders > 1")
    near = written(tokens.join(parts.drop("n").join(heads, "token"), ["token", "part"]).select("doc_id", "token", "first", "head", "holders"), "near")

    def classes(rows: DataFrame) -> DataFrame:
        return connected_components(rows.select("doc_id", F.col("first").alias("other")).unionByName(rows.select(F.col("first").alias("doc_id"), F.col("head").alias("other"))), "doc_id", "other")

    def sized(members: DataFrame) -> DataFrame:
        own = members.join(matrix.select(F.col("doc_id").alias("node"), "n"), "node").groupBy("component")
        return own.agg(F.greatest(F.ceil(F.count("*") / TILE_DOCS), F.ceil(F.sum("n") / TILE_KEYS)).cast("int").alias("tiles"))

    whole = classes(near)
    sizes = written(sized(whole), "sizes")
    scratch = [near, whole, sizes]
    placed = matrix.select("doc_id", "copies", "keys")
    own, stars = whole.join(sizes.where("tiles = 1"), "component"), None
    large = sizes.where("tiles > 1").select("component")
    if large.limit(1).count():
        inside = near.join(whole.join(large, "component", "left_semi").select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
        heavy = classes(inside.where(F.col("holders") > LIGHT))
        heavy_sizes = written(sized(heavy), "sizes")
        pairs = written(_pairs(inside.where(F.col("holders") <= LIGHT), matrix, heavy, percent), "pairs")
        scratch += [heavy, heavy_sizes, pairs]
        own = own.unionByName(heavy.join(heavy_sizes, "component"))
        # A document and its partners are one tile, or several where the partners hold many n-grams.
        salts = pairs.groupBy("a").agg(F.ceil(F.sum("n") / TILE_KEYS).alias("salts"))
        each = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
        of = [F.col("a").alias("component"), F.lit(0).alias("i"), F.lit(1).alias("j"), (F.col("salt") + 1).alias("salt")]
        ends = each.select(*of, F.col("b").alias("doc_id"), F.lit(1).alias("tile")).unionByName(each.select(*of, F.col("a").alias("doc_id"), F.lit(0).alias("tile")).distinct())
        stars = ends.join(placed, "doc_id")
    tiled = placed.join(own.withColumnRenamed("node", "doc_id"), "doc_id").withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    columns = ["component", "i", "j", "salt", "doc_id", "copies", "tile", "keys"]
    tiled = tiled.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).withColumn("salt", F.lit(0).cast("long")).select(*columns)
    return (tiled if stars is None else tiled.unionByName(stars.select(*columns))), scratch


def _pairs(light: DataFrame, matrix: DataFrame, heavy: DataFrame, percent: int) -> DataFrame:
    """``a, b, n``: each pair of documents that share a light n-gram, whose sizes allow a link and that no class of heavy ones holds together; ``n`` is b's size."""
    known = light.select("token", "doc_id").join(matrix.select("doc_id", "n"), "doc_id").join(heavy.select(F.col("node").alias("doc_id"), F.col("component").alias("heavy")), "doc_id", "left")
    held = known.groupBy("token").agg(F.collect_list(F.struct("doc_id", "n", "heavy")).alias("held"))  # LIGHT at most
    both = F.expr(f"""flatten(transform(held, x -> transform(
        filter(held, y -> x.doc_id < y.doc_id and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and not coalesce(x.heavy = y.heavy, false)),
        y -> named_struct('a', x.doc_id, 'b', y.doc_id, 'n', y.n))))""")
    return held.select(F.explode_outer(both).alias("pair")).where("pair is not null").select("pair.*").distinct()


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows without an id all stay."""
    found = jaccard_join(docs, size, percent, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(found, docs[id_col] == found["gone"], "left_anti")
