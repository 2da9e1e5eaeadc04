"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsight.llm import bag_search, byte_cnn, hilbert, supervision
from keepsight.llm.cross_entropy import cross_entropy_difference
from keepsight.llm.licenses import license_scan
from keepsight.llm.line_runs import line_report
from keepsight.llm.near_dup import NearDup, near_duplicates
from keepsight.llm.packing import packed
from keepsight.llm.prefix_trie import conversation_trie
from keepsight.llm.source_mix import mixed
from keepsight.llm.spaced_seeds import contamination
from keepsight.llm.storage import Scratch
from keepsight.llm.token_rollup import TokenLedger, side, token_counts
from keepsight.sources.shared import shared_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = 8
SHARD_DIMS = ["lang", "source", "n_chars", "doc_id"]


@query("op1_hilbert_shards")
def hilbert_shards(spark, sf_dir):
    rows = hilbert.shard_rows(table(spark, sf_dir, "documents"), SHARDS, SHARD_DIMS)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


@query("op2_weak_supervision")
def weak_supervision(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = [*supervision.MEASURES, "base_failed", "kept", "quality"]
    rows = supervision.judged(docs).select("doc_id", "measures.*", "base_failed", "kept", "quality")
    return rows.select("doc_id", *names)


@query("op3_license_rules")
def license_rules(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


@query("op4_spaced_seeds")
def spaced_seeds(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


VOCABULARIES = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}


@query("op5_token_rollup")
def token_rollup(spark, sf_dir):
    return rolled_up(spark, table(spark, sf_dir, "documents"))


def rolled_up(spark, docs):
    """Estimates are inserted, revised to exact counts, and later copies of a text deleted.

    One batch is sent twice, as after a lost answer. What is left counts distinct texts, each
    in the group of its first row by id (null ids last), source and language (null first).
    A null text is no copy of another; each such row stays, with no tokens.
    """
    read = docs.select("doc_id", "source", "lang", F.octet_length("text").alias("bytes"), F.md5("text").alias("body"), "text")
    counted = Scratch("rollup").write(token_counts(read, VOCABULARIES), "counts")
    each = counted.select("source", "lang", "bytes", F.explode("counts").alias("tokenizer", "n"))
    of = lambda tokens: side("source", "lang", F.col("tokenizer"), tokens)
    estimate, exact, none = of(F.ceil(F.col("bytes") / 4)), of(F.col("n")), F.lit(None)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "source", "lang")
    alike = counted.filter("body IS NOT NULL").groupBy("body", row.alias("row")).agg(
        F.count("*").alias("rows"), F.first("counts").alias("counts")
    )
    first = alike.groupBy("body").agg(F.min("row").alias("first"))
    again = F.col("rows") - F.when(F.col("row").eqNullSafe(F.col("first")), 1).otherwise(0)
    copies = alike.join(first, "body").withColumn("times", again).filter("times > 0")
    copies = copies.select("row.source", "row.lang", "times", F.explode("counts").alias("tokenizer", "n"))
    ledger = TokenLedger(spark, shared_path(spark, "token-ledger"))
    ledger.commit("estimates", each.select(none.alias("before"), estimate.alias("after")))
    for _ in range(2):
        ledger.commit("exact-counts", each.select(estimate.alias("before"), exact.alias("after")))
    ledger.compact()
    ledger.commit("copies", copies.select(exact.alias("before"), none.alias("after"), "times"), "times")
    return ledger.totals()


@query("op6_hierarchical_packing")
def hierarchical_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


@query("op7_minhash_near_dup")
def minhash_near_dup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), NearDup(shingle=3, threshold=85))


@query("op8_cross_entropy")
def cross_entropy(spark, sf_dir):
    """Target: documents labelled good and not toxic; background: all documents."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


RUN_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"
LINE_RUNS_SQL = rf"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), flat AS (
  SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS line_no FROM split
), line AS (
  SELECT doc_id, line_no, regexp_extract(raw, '[^\x20\x09-\x0D](.*[^\x20\x09-\x0D])?') AS line,
    len(regexp_extract_all(raw, '{_WORD}')) AS words
  FROM flat WHERE regexp_matches(raw, '{_WORD}')
), placed AS (
  SELECT *, row_number() OVER w - 1 AS pos, sum(words) OVER w - words AS before,
    sum(words) OVER (PARTITION BY doc_id) AS total
  FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), need AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id ORDER BY before
    RANGE BETWEEN CURRENT ROW AND {RUN_WORDS - 1} FOLLOWING) AS need FROM placed
), run AS (
  SELECT a.doc_id, a.pos, a.need, string_agg(b.line, chr(10) ORDER BY b.pos) AS run
  FROM need a JOIN need b ON b.doc_id = a.doc_id AND b.pos BETWEEN a.pos AND a.pos + a.need - 1
  WHERE a.total - a.before >= {RUN_WORDS} GROUP BY ALL
), copy AS (
  SELECT doc_id, pos, need, min({{'d': doc_id, 'p': pos}}) OVER (PARTITION BY run) AS first FROM run
), covered AS (
  SELECT doc_id, pos + unnest(range(need)) AS pos, first.d AS source FROM copy
  WHERE first.d <> doc_id OR pos >= first.p + need
), gone AS (
  SELECT doc_id, pos, min(source) AS source FROM covered GROUP BY ALL
), hit AS (
  SELECT doc_id, list(line_no::INT ORDER BY line_no) AS lines, sum(words)::BIGINT AS words,
    list_sort(list(DISTINCT source)) AS sources
  FROM gone JOIN placed USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, coalesce(array_to_string(lines, ','), '') AS deleted_lines, coalesce(words, 0)::BIGINT AS n_deleted_words,
  coalesce(array_to_string(sources, ','), '') AS copied_from
FROM documents LEFT JOIN hit USING (doc_id)"""


@query("op9_line_suffix_array", LINE_RUNS_SQL)
def line_suffix_array(spark, sf_dir):
    rows = line_report(table(spark, sf_dir, "documents"), RUN_WORDS)
    listed = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("deleted_lines", "copied_from")}
    return rows.withColumns(listed)


@query("op10_byte_cnn")
def language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = lambda c: F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(4)) == 2, F.lit(False))
    rows = byte_cnn.identify(docs, ~held(F.col("doc_id")))
    return rows.select("doc_id", held(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


BAG_SEARCH_SQL = r"""
WITH low AS (
  SELECT row_number() OVER () AS r, doc_id,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), word AS (
  SELECT r, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low
), tf AS (SELECT r, term, count(*) AS tf FROM word GROUP BY ALL),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), part AS (
  SELECT item_id, r, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l))) AS part
  FROM item JOIN df USING (term) JOIN tf USING (term) JOIN len USING (r), total
), scored AS (SELECT item_id, r, sum(part)::BIGINT AS score FROM part GROUP BY ALL),
placed AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
  FROM scored JOIN low USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10"""


@query("op11_bag_search", BAG_SEARCH_SQL)
def bag_dedup_search(spark, sf_dir):
    found = bag_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("item", "item_id")


TRIE_SQL = """
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::UBIGINT], range(8)::UBIGINT[]),
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) AS v
    FROM range(256) r(i))
), turn AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text}
    ORDER BY turn NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) AS turns FROM turn GROUP BY conv_id
), head AS (
  SELECT conv_id, turns, conv_id - conv_id % 20 AS p, (xor(list_reduce(list_concat([4294967295::UBIGINT],
    list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 4)::BIGINT AS h FROM own, crc
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(p.turns[1:h], []), o.turns[h + 1:]) AS turns
  FROM head o LEFT JOIN own p ON p.conv_id = o.p
), member AS (
  SELECT conv_id, depth, turns[1:depth] AS path, len(turns) = depth AS ends
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)
), node AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1)
      * len(regexp_extract_all(path[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM member GROUP BY depth, path
), child AS (
  SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (depth, path)
), above AS (
  SELECT saved, n_children = 0 AS leaf, d AS depth, path[1:d] AS path
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted)
), below AS (
  SELECT depth, path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM above GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM counted n JOIN below USING (depth, path) LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]"""


@query("op12_prefix_trie", TRIE_SQL)
def prefix_trie(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations"))


SOURCE_MIX_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight FROM doc GROUP BY source
), filled AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
    coalesce(sum(2 * source_size) OVER w, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open
  FROM src WINDOW w AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT coalesce(max((budget - held) / open) FILTER (WHERE (budget - held) / open * weight <= 2 * source_size), 0) AS level FROM filled
), target AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, level * weight) AS target FROM src, level
), shuffled AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS wanted,
    (sum(size) OVER (PARTITION BY doc.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size, r) - size)::BIGINT AS start
  FROM doc JOIN target ON doc.source IS NOT DISTINCT FROM target.source
)
SELECT doc_id, size, source_size, target, greatest(0, least(size, wanted - start))
  + greatest(0, least(size, wanted - source_size - start)) AS taken FROM shuffled"""


@query("op13_source_mix", SOURCE_MIX_SQL)
def source_mix(spark, sf_dir):
    rows, pieces = mixed(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    taken = rows.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return taken.select("doc_id", "size", "source_size", "target", "taken")
