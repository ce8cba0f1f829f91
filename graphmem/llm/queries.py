"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphmem.llm.toxicity import fit, score

    docs = _documents(spark, sf_dir, "doc_id", "text")
    learned = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_remainder(5) != 0)
    found = score(docs, fit(docs, learned))
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphmem.llm.decontaminate import contamination

    found = contamination(_documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)
    items = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphmem.llm.license_scan import license_scan

    found = license_scan(_documents(spark, sf_dir, "doc_id", "text"))
    labels = F.array_sort(F.array_union("base_labels", "rule_labels"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score")


OP2_SQL = r"""
with word as (
    select 'd' as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
    union all
    select 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), item as (
    select id, least(10, len(w)) as n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from word where kind = 'i' and len(w) > 0
), gram as (
    select distinct id, n, array_to_string(w[i : i + n - 1], ' ') as g from item
), place as (
    select id, w, n, unnest(range(1, len(w) - n + 2)) as i from word, (select distinct n from gram) where kind = 'd' and len(w) >= n
), spelled as (
    select id, n, i, array_to_string(w[i : i + n - 1], ' ') as g from place
), hit as (
    select s.id, s.i, s.n, gram.id as item from spelled s join gram on gram.g = s.g and gram.n = s.n
), covered as (
    select id, count(distinct p) as n_hit from (select id, unnest(range(i, i + n)) as p from hit) group by id
), listed as (
    select id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct id, cast(item as varchar) as item from hit) group by id
)
select word.id as doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from word left join covered on covered.id = word.id left join listed on listed.id = word.id where kind = 'd'
"""


def _tokenizer(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphmem.llm.sentencepiece_codec import encode

    encoded = encode(_documents(spark, sf_dir, "doc_id", "text"), _tokenizer(), verify_col="round_trip")
    return encoded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("pieces_hash"), "round_trip")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphmem.llm.quality_rules import quality_rules

    return quality_rules(_documents(spark, sf_dir, "doc_id", "text"))


OP4_SQL = r"""
with doc as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), figure as (
    select doc_id, cast(len(w) as bigint) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols from doc
), line as (
    select doc_id, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as n, strlen(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) as size, len(regexp_extract_all(l, '\|')) as bars,
        len(regexp_extract_all(l, '[#*$%&<>]')) as marks, len(regexp_extract_all(l, '[.!?]')) as stops from (select doc_id, unnest(string_split(text, chr(10))) as l from doc)
), judged as (
    select *, n > 0 and ((bars >= 3 and bars * 6 >= n) or (marks * 2 > n and marks > 2)
        or (not regexp_matches(l, '[ENDINGS][\x20\x09-\x0D]*$') and not regexp_matches(l, '^[\x20\x09-\x0D]*([-*+\x{2022}\x{2013}]|[0-9]+[.)])([\x20\x09-\x0D]|$)') and stops * 40 < n)
        or (n <= 12 and regexp_matches(l, 'BOILERPLATE', 'i'))) as failed from line
), part as (
    select doc_id, count(*) filter (n > 0) - count(distinct l) filter (n > 0) as n_dup_lines, coalesce(sum(size) filter (failed), 0) / greatest(1, sum(size)) as lost from judged group by doc_id
), grams as (
    select doc_id, list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' ')) as g from doc where len(w) >= 8
), place as (
    select doc_id, unnest(g) as gram, unnest(range(1, len(g) + 1)) as i from grams
), again as (
    select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from place qualify count(*) over (partition by doc_id, gram) > 1) group by doc_id
), known as (
    select figure.*, n_dup_lines, coalesce(again.n, 0) as n_repeat_words, cast(lost as double) as lost from figure join part using (doc_id) left join again using (doc_id)
)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and lost <= 0.5 as kept from known
"""


def _op4_sql() -> str:
    from graphmem.llm.quality_rules import BOILERPLATE, ENDINGS

    ends = ENDINGS.replace("]", r"\]").replace("'", "''")
    return OP4_SQL.replace("ENDINGS", ends).replace("BOILERPLATE", BOILERPLATE.pattern.decode())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphmem.llm.language_id import fit, identify

    model = fit(_documents(spark, sf_dir, "doc_id", "text", "lang").where(_remainder(4) != 2))
    found = identify(_documents(spark, sf_dir, "doc_id", "text"), model)
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphmem.llm.chat_template import format_conversations, read_back

    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(format_conversations(rows.unionByName(own)))


OP6_SQL = """
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(length(role) + length(text) + 23) + case when conv_id = -7 then 6 else 0 end as bigint) as formatted_chars
from rows group by conv_id
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphmem.llm.jaccard_join import jaccard_join

    return jaccard_join(_documents(spark, sf_dir, "doc_id", "text"), 3, 90).select("doc_id", "n_shingles", "component_id", "n_links")


OP7_SQL = r"""
with recursive word as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), grams as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) end as g from word
), each as (
    select doc_id, len(g) as n, unnest(g) as gram from grams
), pair as (
    select a.doc_id as x, b.doc_id as y from each a join each b on a.gram = b.gram and a.doc_id <> b.doc_id and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(x, y) as (
    select x, y from pair union select reach.x, pair.y from reach join pair on reach.y = pair.x
), least_of as (
    select x, min(y) as y from reach group by x
), degree as (
    select x, count(*) as n from pair group by x
)
select doc_id, cast(len(g) as bigint) as n_shingles, least(doc_id, coalesce(y, doc_id)) as component_id, coalesce(degree.n, 0) as n_links
from grams left join least_of on least_of.x = doc_id left join degree on degree.x = doc_id
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphmem.llm.token_counts import token_counts

    return token_counts(_documents(spark, sf_dir, "doc_id", "text"), _tokenizer(), 4096)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphmem.llm.substring_dedup import substring_dedup

    out = substring_dedup(_documents(spark, sf_dir, "doc_id", "text"), 13, joined=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
with doc as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), grams as (
    select doc_id, list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' ')) as g from doc where len(w) >= 13
), place as (
    select doc_id, unnest(g) as gram, unnest(range(1, len(g) + 1)) as i from grams
), first as (
    select gram, min(doc_id) as d from place group by gram
), gone as (
    select distinct doc_id, unnest(range(i, i + 13)) as p from place join first using (gram) where d < doc_id
), word as (
    select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from doc
), kept as (
    select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from word anti join gone using (doc_id, p) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from doc left join kept using (doc_id)
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_sentencepiece_codec, op4_quality_rules, op5_language_id, op6_chat_format, op7_jaccard_join, op8_token_counts, op9_substring_dedup, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op4_quality_rules": _op4_sql(), "op6_chat_format": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op9_substring_dedup": OP9_SQL}
