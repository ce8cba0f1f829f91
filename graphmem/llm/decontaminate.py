"""Benchmark decontamination with DataFrame functions only.

The windows of all test items make a hash set of 64-bit fingerprints, broadcast while its counted size allows and taken
in several passes by ranges of the fingerprint beyond.  Training windows are scanned inside the stage that reads the
texts: three words of a window give its fingerprint, and only windows whose fingerprint is in the set are spelled out, verified
against the whole test window and kept.  Then hit spans, or whole documents, can be removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmem.llm.plainwords import BETWEEN, words
from graphmem.llm.shared import discard, written

#: Up to so many bytes of test windows, the table that verifies them is the broadcast set itself.
MAX_VERIFYING_BYTES = 24 << 20
#: Fingerprints of one broadcast set; a set of more is taken in several passes.
PASS = 2_000_000
#: Up to so many bytes of hits, they are broadcast to the texts they are cut out of.
MAX_HIT_BYTES = 24 << 20


def item_windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``gram, len, fingerprint, item_ids``: each distinct window, and the items that have it.

    An item of fewer than ``size`` words, but not none, is one window.  Null texts have none; null ids are left out of ``item_ids``.
    """
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    own = F.least(F.size("w"), F.lit(size))
    each = w.withColumn("len", own).select("item_id", "len", "w", F.explode(F.expr("sequence(0, size(w) - len)")).alias("i"))
    grams = each.select("item_id", "len", F.expr("array_join(slice(w, i + 1, len), ' ')").alias("gram"), F.expr("xxhash64(w[i], w[i + (len - 1) div 2], w[i + len - 1])").alias("fingerprint"))
    return grams.groupBy("gram", "len", "fingerprint").agg(F.collect_set("item_id").alias("item_ids"))


def _scanned(tokens: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """``keep, w, pos, len, fingerprint`` of each window of these lengths, and a row with ``pos`` -1 for each row of ``tokens``.

    A row's fingerprints are one array of 64-bit integers, one length after the other; the stage that
    makes the rows also looks them up, so they are never stored, and ``w`` is not copied.
    """
    prints = [F.expr(f"case when size(w) >= {n} then transform(sequence(0, size(w) - {n}), i -> xxhash64(w[i], w[i + {(n - 1) // 2}], w[i + {n - 1}])) else cast(array() as array<bigint>) end") for n in lengths]
    all_ = F.concat(F.expr("array(cast(null as bigint))"), *prints)
    # The fingerprints are a column of their own: a generator that computes them would leave generated code, and copy ``w`` for each.
    # Outer, though no array is empty: else a filter on the array's size is pushed down, and splits the text for each of its words.
    each = tokens.select(*keep, "w", all_.alias("prints")).select(*keep, "w", F.posexplode_outer("prints").alias("at", "fingerprint"))
    pos, length, before = F.lit(-1), F.lit(0), F.lit(1)
    for n in lengths:
        inside = F.col("at") >= before
        pos, length = F.when(inside, F.col("at") - before).otherwise(pos), F.when(inside, F.lit(n)).otherwise(length)
        before = before + F.greatest(F.size("w") - (n - 1), F.lit(0))
    return each.select(*keep, "w", pos.alias("pos"), length.alias("len"), "fingerprint")


def _verified(tokens: DataFrame, windows: DataFrame, keep: list[str], scratch: list[DataFrame]) -> DataFrame:
    """A row for each window of ``tokens`` (with column ``w``) that is a test window, and one without for each row: ``keep, pos, len, item_ids``."""
    windows = written(windows, "windows")
    scratch.append(windows)
    size = windows.agg(F.count("*"), F.sum(F.octet_length("gram") + 64)).first()
    lengths = [r[0] for r in windows.select("len").distinct().orderBy("len").collect()]  # ``size`` values at most
    if (size[1] or 0) <= MAX_VERIFYING_BYTES:
        known = windows.select(F.col("fingerprint").alias("known"), F.col("gram").alias("known_gram"), "item_ids")
        found = _scanned(tokens, lengths, keep).join(F.broadcast(known), F.col("fingerprint") == F.col("known"), "left")
        return found.where("pos < 0 or (known is not null and array_join(slice(w, greatest(pos, 0) + 1, len), ' ') = known_gram)").select(*keep, "pos", "len", "item_ids")
    passes = -(-windows.select("fingerprint").distinct().count() // PASS)
    if passes > 1:
        tokens = written(tokens, "tokens")
        scratch.append(tokens)
    out = None
    for part in range(passes):
        here = F.pmod(F.col("fingerprint"), F.lit(passes)) == part
        known = windows.where(here).select(F.col("fingerprint").alias("known")).distinct()
        found = _scanned(tokens, lengths, keep).where(F.col("fingerprint").isNull() | here) if passes > 1 else _scanned(tokens, lengths, keep)
        found = found.join(F.broadcast(known), F.col("fingerprint") == F.col("known"), "left").where("known is not null" + " or pos < 0" * (part == 0))
        found = found.select(*keep, "pos", "len", F.expr("case when pos >= 0 then array_join(slice(w, greatest(pos, 0) + 1, len), ' ') end").alias("gram"))
        if passes > 1:  # one set at a time in the executors' memory
            found = written(found, "found")
            scratch.append(found)
        out = found if out is None else out.unionByName(found)
    bare = out.where("pos < 0").drop("gram").withColumn("item_ids", F.lit(None).cast("array<string>"))
    # A window that very many texts have is one row of ``windows`` and many of ``out``: dealt over so many salts.
    salted = windows.select("gram", "item_ids", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    hits = out.where("pos >= 0").withColumn("salt", F.pmod(F.xxhash64("pos", *keep), F.lit(16)).cast("int"))
    return bare.unionByName(hits.join(salted, ["gram", "salt"]).select(*keep, "pos", "len", "item_ids"))


#: Numbers of the words that hits cover, in order; a hit is a place and a length.
_COVERED = "array_sort(array_distinct(flatten(transform(filter(hits, h -> h.pos >= 0), h -> sequence(h.pos, h.pos + h.len - 1)))))"
#: From the covered words, runs of consecutive ones: the first word of each, and the word after its last.
_SPANS = """zip_with(
    filter(covered, (x, i) -> i = 0 or covered[i - 1] <> x - 1),
    filter(covered, (x, i) -> i = size(covered) - 1 or covered[i + 1] <> x + 1),
    (a, b) -> named_struct('lo', a, 'hi', b + 1))"""


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids, spans`` of each row.

    ``n_hit``: words inside any occurrence of a test window; ``item_ids``: strings, sorted; ``spans``: of words,
    merged, each from ``lo`` to before ``hi``.  A null or empty text has no words and is never hit; without items
    nothing is, and without documents there are no rows.  Ids may be null or repeat: each row is judged on its own.  Other columns are not read.
    """
    tokens = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    tokens = tokens.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "w")
    rows = _verified(tokens, item_windows(items, size), ["row", "doc_id", "n_words"], [])
    each = rows.groupBy("row", "doc_id", "n_words").agg(F.collect_set(F.struct("pos", "len")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    spans = each.withColumn("covered", F.expr(_COVERED))
    return spans.select("doc_id", "n_words", F.size("covered").cast("long").alias("n_hit"), "item_ids", F.expr(_SPANS).alias("spans"))


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 10, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without what is hit: ``remove='documents'`` drops documents, ``'spans'`` cuts the hit words out of texts.

    Where a word goes, what stands between it and the next word goes too; what precedes the first word stays.  Texts that are not hit
    are unchanged; ``length_col`` follows a changed text.  Rows are matched by id and a hash of the text, nulls too.  The
    hits are written first: while they are few, by their counted bytes, they go to the texts, which then are not shuffled.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    key = {"_id": F.col(id_col), "_hash": F.xxhash64(F.col(text_col))}
    tokens = docs.select(*[c.alias(k) for k, c in key.items()], words(F.col(text_col)).alias("w"))
    scratch: list[DataFrame] = []
    hits = _verified(tokens, item_windows(items, size), list(key), scratch).where("pos >= 0")
    spans = written(hits.groupBy(*key).agg(F.collect_set(F.struct("pos", "len")).alias("hits")).select(*key, F.expr(_COVERED).alias("covered")), "hits")
    for df in scratch:
        discard(df)
    small = (spans.agg(F.sum(32 + 4 * F.size("covered"))).first()[0] or 0) <= MAX_HIT_BYTES
    spans = F.broadcast(spans) if small else spans
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), *[c.alias(f"own{k}") for k, c in key.items()])
    same = F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_hash") == F.col("_hash"))
    if remove == "documents":
        return named.join(spans, same, "left_anti").select("r.*")
    solid, gap = BETWEEN[:-1].replace("[", "[^").replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"), BETWEEN[:-1].replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    both = named.join(spans, same, "left").withColumn("t", F.col(f"r.`{text_col}`"))
    cut_up = both.withColumn("pieces", F.when(F.col("covered").isNotNull(), F.regexp_extract_all("t", F.lit(f"{solid}+{gap}*"), F.lit(0))))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(pieces) - 1), covered), i -> pieces[i]), '')")
    both = cut_up.withColumn("cut", F.when(F.col("covered").isNotNull(), F.concat(F.regexp_extract("t", f"^{gap}*", 0), kept)).otherwise(F.col("t")))
    columns = {c: F.col(f"r.`{c}`") for c in docs.columns} | {text_col: F.col("cut")}
    if length_col in docs.columns:
        columns[length_col] = F.when(F.col("covered").isNotNull(), F.length("cut")).otherwise(F.col(f"r.`{length_col}`")).cast(docs.schema[length_col].dataType)
    return both.select(*[columns[c].alias(c) for c in docs.columns])
