"""The opN queries: operators with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import LOWER, UPPER
from wordloom.plans.staging import Workspace

from . import bpe, conversation_repair, decontaminate, html_text, jaccard_join, lexical_rank, license_scan, line_dedup, packing, pii, quality_rules, topk, warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    both = bpe.encode_decode(_table(spark, sf_dir, "documents"), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Workspace(spark, "quality").write(quality_rules.ledger(_table(spark, sf_dir, "documents")), "ledger")
    return quality_rules.judge(book).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of two policies costs, from one ledger."""
    book = Workspace(spark, "quality").write(quality_rules.ledger(_table(spark, sf_dir, "documents")), "ledger")
    each = [quality_rules.ablate(book, policy).withColumn("policy", F.lit(policy)) for policy in ("v1", "lenient")]
    return each[0].unionByName(each[1])


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = Workspace(spark, "warc").write(warc.round_trip(_table(spark, sf_dir, "pages")).drop("payload"), "records")
    return warc.checked(back).select(warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to").alias("refers_to"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("spans"), pii.BASE), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    before, dropped = clean.columns[-2:]
    return clean.select("doc_id", F.col(before).alias("n_lines"), F.col(dropped).alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("overlap")
    found = decontaminate.find_overlaps(docs, _table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join(out["items"], ","), 256)
    return found.select("doc_id", out["n_words"].alias("n_words"), out["n_hit"].alias("n_hit"), F.size(out["items"]).cast("long").alias("n_items"), ids.alias("items_sha256"), (out["n_hit"] > 0).alias("contaminated"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_book(conversation_repair.damage(_table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_bpe_encode_decode, op3_quality_rules, rule_ablation, op4_best_fit_packing, op5_exact_top_k, op6_license_scan, op7_html_extraction, op8_warc_round_trip, op9_pii, op10_line_dedup, op11_decontamination, op12_lexical_search, op13_conversation_repair)}

_WORD_SPLIT = r"regexp_split_to_array(t, '[\x20\x09-\x0D]+')"
_DOCS = "SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents"


def _op3_sql() -> str:
    return rf"""
WITH d AS ({_DOCS}),
w AS (SELECT rid, list_filter({_WORD_SPLIT}, lambda x: x <> '') AS w FROM d),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
        len(l.l)::BIGINT AS n_lines, (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines,
        coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
        + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN 100 * n_capitals > 30 * word_chars THEN 16 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
        + CASE WHEN word_chars > 40 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed % 4 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""


def _ablation_sql() -> str:
    mask = lambda policy: f"(failed & {quality_rules.POLICIES[policy]})"
    one = lambda policy, bit, name: f"""SELECT {bit} AS bit, '{name}' AS rule, count(*) FILTER (failed & {1 << bit} > 0)::BIGINT AS n_failed, count(*) FILTER ({mask(policy)} = {1 << bit})::BIGINT AS n_only,
 count(*) FILTER ({mask(policy)} & {~(1 << bit) & 0xFFFF} = 0)::BIGINT AS n_kept_without, '{policy}' AS policy FROM book HAVING count(*) > 0"""  # noqa: E731
    parts = [one(policy, bit, name) for policy in ("v1", "lenient") for bit, (name, _) in quality_rules.RULES.items() if quality_rules.POLICIES[policy] >> bit & 1]
    return f"WITH book AS ({_op3_sql()}) " + " UNION ALL ".join(parts)


def _op10_sql() -> str:
    return r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (SELECT rid, doc_id, i, l[i] AS line, translate(regexp_replace(regexp_replace(l[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d)),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, s.first IS NOT NULL AND k.doc_id <> s.first AS gone FROM k LEFT JOIN s USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid
"""


def _canonical_sql(text: str) -> str:
    form = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    form = f"array_to_string(list_filter(string_split({form}, chr(10)), lambda x: length(x) > {license_scan.COPYRIGHT_CHARS} OR NOT regexp_matches(x, '{license_scan.COPYRIGHT_LINE}')), chr(10))"
    form = f"' ' || regexp_replace({form}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for old, new in license_scan.EQUIVALENT:
        form = f"replace({form}, ' {old} ', ' {new} ')"
    return f"trim({form})"


def _op6_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in license_scan.LICENSES.items())
    return f"""
WITH known AS (SELECT sha256({_canonical_sql('text')}) AS digest, min(license_id) AS license_id FROM (VALUES {values}) AS v(license_id, text) GROUP BY 1),
f AS (SELECT doc_id, {_canonical_sql('text')} AS form FROM documents),
g AS (SELECT doc_id, length(form)::BIGINT AS canonical_chars, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM f)
SELECT doc_id, canonical_chars, g.digest, license_id FROM g LEFT JOIN known ON g.digest = known.digest
"""


def _op5_sql() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id AS query_id, t AS own FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, coalesce(list_sum(list_transform(list_zip(own, t, TRUE), lambda z: z[1] * z[2])), 0)::BIGINT AS score FROM q JOIN v ON query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op8_sql() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS top FROM g WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, g.payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM g LEFT JOIN m ON g.payload_digest = m.payload_digest
"""


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _op11_sql() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, {_TERMS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[pos + 1:pos + k], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS pos FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, pos, k, array_to_string(w[pos + 1:pos + k], ' ') AS g FROM (SELECT rid, w, k, unnest(range(0, len(w) - k + 1)) AS pos FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT rid, pos, dw.k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
n AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(pos, pos + k)) AS p FROM (SELECT DISTINCT rid, pos, k FROM hit)) GROUP BY rid),
s AS (SELECT rid, count(*) FILTER (item_id IS NOT NULL) AS n, coalesce(string_agg(item_id, ',' ORDER BY item_id), '') AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN s USING (rid)
"""


def _op12_sql() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
z AS (SELECT count(*)::BIGINT AS cn, sum(len(w))::BIGINT AS cl FROM d WHERE len(w) > 0),
q AS (SELECT qid, item_id, term, count(*)::BIGINT AS c FROM (SELECT row_number() OVER () AS qid, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * cn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, z GROUP BY term, cn),
s AS (SELECT qid, item_id, rid, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * cn) // cl))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), z GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def _op13_sql() -> str:
    """Forwards: for each state after each row the cheapest repair as a struct of cost, audit and text, whose order is the wanted one."""
    then = lambda s, cost, letter, role="", text="''": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'r': " + (f"{s}.r || CASE WHEN {s}.r = '' THEN '' ELSE chr(10) END || {role} || ':' || {text}}}" if role else f"{s}.r}}")
    least = lambda *x: f"list_min([{', '.join(x)}])"
    far = "{'c': 1000000000000::BIGINT, 'a': '', 'r': ''}"
    if_ = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE {far} END"
    keep = lambda s, initial: if_(f"ini = '{initial}' AND fault IN (0, 3)", then(s, "late", "K", "role", "text"))
    role = lambda s, to: if_("fault IN (0, 3)", then(s, "3 + late", "R", f"'{to}'", "text"))
    gone = lambda s: then(s, 4, "D")
    return rf"""
WITH RECURSIVE src AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 20 AS d FROM src),
dam AS (SELECT k, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM dam),
f AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS was, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '(?s)[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault FROM o),
g AS (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS late FROM f),
walk AS (SELECT k, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0, {far} AS s1, {{'c': 3::BIGINT, 'a': 'I', 'r': 'user:'}} AS s2, {{'c': 6::BIGINT, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'}} AS s3 FROM (SELECT DISTINCT k FROM g)
  UNION ALL SELECT k, i, t0, t1, u2, {least("t3", then("u2", 3, "I", "'assistant'"))} FROM (
    SELECT *, {least("t2", then("t0", 3, "I", "'user'"), then("t1", 3, "I", "'user'"), then("t3", 3, "I", "'user'"))} AS u2 FROM (
      SELECT walk.k, g.i, {gone("s0")} AS t0, {least(gone("s1"), keep("s0", "s"))} AS t1,
        {least(gone("s2"), keep("s0", "u"), keep("s1", "u"), keep("s3", "u"), role("s0", "user"), role("s1", "user"), role("s3", "user"))} AS t2,
        {least(gone("s3"), keep("s2", "a"), role("s2", "assistant"))} AS t3
      FROM walk JOIN g ON g.k = walk.k AND g.i = walk.i + 1))),
best AS (SELECT k, max_by({least("s0", "s3")}, i) AS b FROM walk GROUP BY k),
h AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (was || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY k)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM src) LEFT JOIN h USING (k) LEFT JOIN best USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": _op3_sql(), "rule_ablation": _ablation_sql(), "op5_exact_top_k": _op5_sql(), "op6_license_scan": _op6_sql(), "op8_warc_round_trip": _op8_sql(), "op10_line_dedup": _op10_sql(), "op11_decontamination": _op11_sql(), "op12_lexical_search": _op12_sql(), "op13_conversation_repair": _op13_sql()}
