"""The registered queries of the training-data operators: thin projections of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakforge.llm.warc import read_warc, write_warc

    records = read_warc(write_warc(table(spark, sf_dir, "pages")))
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakforge.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakforge.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakforge.llm.toxicity import rate

    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakforge.llm.quality import adaptive_filter

    return adaptive_filter(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakforge.llm.mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH r AS (
  SELECT doc_id, source, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ' ', md5(coalesce(text, '')))) AS shuffle,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM r GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][CAST((place - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM p),
b AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
    sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing
  FROM w),
l AS (SELECT *, (budget - before) / sharing AS reach FROM b),
f AS (
  SELECT *, cap / weight <= reach AS full_up,
    (min(CASE WHEN NOT cap / weight <= reach THEN {'before': before, 'reach': reach} END) OVER ()).reach AS level
  FROM l),
t AS (SELECT *, CASE WHEN full_up OR level IS NULL THEN cap ELSE weight * level END AS target FROM f),
g AS (SELECT *, row_number() OVER (PARTITION BY source, shuffle) AS k FROM r),
q AS (
  SELECT g.*, t.source_size, t.target, t.place, t.weight, t.budget,
    sum(g.size) OVER (PARTITION BY t.place ORDER BY shuffle, k ROWS UNBOUNDED PRECEDING) AS given
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (given + pass * source_size) / weight AS finish FROM q, (VALUES (0), (1)) AS x(pass) WHERE size > 0),
c AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place, pass, shuffle, k ROWS UNBOUNDED PRECEDING) AS used FROM e),
n AS (SELECT source, shuffle, k, count(*) AS copies FROM c WHERE used <= budget GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(n.copies, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.source IS NOT DISTINCT FROM n.source AND q.shuffle = n.shuffle AND q.k = n.k
"""


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakforge.llm.licenses import scan

    both = F.array_sort(F.array_union("base", "found"))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), "score"
    )


def _op7_sql() -> str:
    from peakforge.llm.licenses import LINES, PHRASES, TEMPLATES, telling, words_of

    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    wanted = [(label, sorted(set(words_of(t)))) for label, ts in TEMPLATES.items() for t in ts]
    rows = ", ".join(f"({k}, '{label}', {ws}, {must}::VARCHAR[])" for k, ((label, ws), must) in enumerate(zip(wanted, telling(wanted, 0.8), strict=True)))
    places = []
    for phrase, label in PHRASES.items():
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split()))
        places.append(f"list_transform(list_filter(range(len(w)), lambda i: {same}), lambda i: {{'at': i, 'label': '{label}'}})")
    return f"""
WITH t(tid, label, words, must) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS x FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, {word}) AS w FROM d),
p AS (SELECT r, doc_id, x, len(w) AS n_words, {" || ".join(places)} AS p FROM w),
l AS (SELECT r, string_split(x, chr(10)) AS lines FROM d),
a AS (SELECT r, lines, unnest(range(len(lines))) AS first FROM l),
b AS (
  SELECT r, first, n, list_distinct(regexp_extract_all(array_to_string(lines[first + 1 : first + n], chr(10)), {word})) AS block
  FROM a, range(1, {LINES + 1}) AS s(n) WHERE first + n <= len(lines)),
v AS (SELECT list_distinct(flatten(list(words))) AS known FROM t),
k AS (SELECT r, first, n, list_intersect(block, known) AS block FROM b, v WHERE len(list_intersect(block, known)) > 0),
m AS (
  SELECT r, first, n, tid, label, list_intersect(block, words) AS shared, len(list_intersect(block, words)) / len(words) AS share FROM k, t
  WHERE len(list_intersect(block, words)) >= ceil(0.8 * len(words)) AND len(list_intersect(block, must)) = len(must)),
o AS (
  SELECT * FROM m WHERE NOT EXISTS (
    SELECT 1 FROM m y WHERE y.r = m.r AND y.first = m.first AND y.n = m.n AND y.tid <> m.tid AND len(list_intersect(m.shared, y.shared)) = len(m.shared)
      AND (len(y.shared) > len(m.shared) OR (len(y.shared) = len(m.shared) AND y.share > m.share)))),
f AS (SELECT r, list(DISTINCT label) AS found, max(share) AS share FROM o GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base,
  list_min(list_transform(p, lambda q: q.at)) AS first_word, list_max(list_transform(p, lambda q: q.at)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda q: q.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda q: q.label) || coalesce(found, []))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM p LEFT JOIN f USING (r)
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakforge.llm.simhash import hex_fp, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fp("fp").alias("fingerprint"), "component_id")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakforge.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakforge.llm.tokens import read_shards, write_shards

    return read_shards(write_shards(table(spark, sf_dir, "documents"))).select("doc_id", "start", "n_tokens", "ids_crc32")


#: The 256 entries of the crc32 table, each from eight halvings with the polynomial.
CRC_SQL = """crc AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS crc
  FROM (SELECT unnest(range(256)) AS b))"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes; needs the table of CRC_SQL."""
    raw = f"hex(encode({text}))"
    seen = f"list_transform(range(1, len({raw}), 2), lambda i: CAST('0x' || {raw}[i : i + 1] AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {seen}), lambda c, y: xor(c // 256, crc[CAST(xor(c % 256, y) + 1 AS INT)])), 4294967295)"


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakforge.llm.contextmix import score_texts

    return score_texts(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakforge.llm.spelling import group_variants

    return group_variants(table(spark, sf_dir, "documents"))


def _op12_sql() -> str:
    return f"""
WITH RECURSIVE {CRC_SQL},
o AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS k FROM o GROUP BY ALL),
h AS (SELECT run, k, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM c, crc),
d AS (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
g AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM g),
p AS (
  SELECT a.word, b.word AS near, b.n AS m FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.less = w.word
  UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.less = w.word),
f AS (SELECT word, count(*) AS n_near, min({{'minus': -m, 'near': near}}) AS best FROM p GROUP BY word),
t AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.minus >= 5 * w.n THEN best.near END AS form, CASE WHEN -best.minus >= 5 * w.n THEN -best.minus END AS form_n
  FROM w LEFT JOIN f USING (word)),
r(word, here, form) AS (
  SELECT word, word, form FROM t UNION ALL SELECT r.word, t.word, t.form FROM r JOIN t ON r.form = t.word)
SELECT t.word, t.form, r.here AS root, t.n, t.n_near, t.form_n FROM t JOIN r ON t.word = r.word AND r.form IS NULL
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peakforge.llm.repair import repair

    return repair(table(spark, sf_dir, "conversations"))


def _op13_sql() -> str:
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def then(state: str, cost: object, edit: str, line: str = "''") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || {line}}} END"

    def least(*options: str) -> str:
        return f"list_min(list_filter([{', '.join(options)}], lambda q: q IS NOT NULL))"

    def row(initial: str, name: str, *states: str) -> list[str]:
        kept = [f"CASE WHEN stays AND initial = '{initial}' THEN {then(s, 'extra', 'K', 'chr(10) || role || chr(58) || text')} END" for s in states]
        given = [f"CASE WHEN stays THEN {then(s, '2 + extra', 'R', f"chr(10) || '{name}:' || text")} END" for s in states if name]
        return kept + given

    def insert(name: str, *states: str) -> list[str]:
        return [then(s, 2, "I", f"chr(10) || '{name}:'") for s in states]

    return f"""
WITH RECURSIVE {CRC_SQL},
o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f
  FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM o),
r AS (
  SELECT conv_id, turn, role, text, role[1] AS initial, rtrim(text, {space}) AS said, row_number() OVER c AS i, lag(role[1]) OVER c AS before
  FROM d WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM r),
g AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN said[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra
  FROM h),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM g GROUP BY conv_id),
p(conv_id, i, q0, q1, q2, q3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 't': ''}}, CAST(NULL AS STRUCT(c INT, a VARCHAR, t VARCHAR)), {{'c': 2, 'a': 'I', 't': chr(10) || 'user:'}},
    {{'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}
  FROM n
  UNION ALL
  SELECT conv_id, i, m0, m1, k2, {least("m3", *insert("assistant", "k2"))} FROM (
    SELECT conv_id, i, m0, m1, m3, {least("m2", *insert("user", "m0", "m1", "m3"))} AS k2 FROM (
      SELECT p.conv_id, g.i, {then("q0", 3, "D")} AS m0, {least(then("q1", 3, "D"), *row("s", "", "q0"))} AS m1,
        {least(then("q2", 3, "D"), *row("u", "user", "q0", "q1", "q3"))} AS m2, {least(then("q3", 3, "D"), *row("a", "assistant", "q2"))} AS m3
      FROM p JOIN g ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = p.i + 1))),
e AS (SELECT n.*, {least("q0", "q3")} AS q FROM p JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.i = n.n)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(q.c, 0)::BIGINT AS cost, coalesce(q.a, '') AS audit,
  sha256(substr(coalesce(q.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing": op6_mixing,
    "op7_licenses": op7_licenses,
    "op8_simhash": op8_simhash,
    "op9_main_text": op9_main_text,
    "op10_token_ids": op10_token_ids,
    "op11_lm_score": op11_lm_score,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op6_mixing": OP6_SQL, "op7_licenses": _op7_sql(), "op12_spelling_variants": _op12_sql(), "op13_conversation_repair": _op13_sql()}
