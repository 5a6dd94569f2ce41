"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html, jaccard, licenses, lines, media, names, packing, pii, search, toxicity, urls
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(licenses.with_paths(table(spark, sf_dir, "documents")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(chat.chat_windows(chat.with_probe(spark, table(spark, sf_dir, "conversations"))))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_sentences", "offending")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(lines.dedup_lines(table(spark, sf_dir, "documents")))


def op13_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.vendor_clients(table(spark, sf_dir, "clients"), table(spark, sf_dir, "vendors"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_pii, op3_url_filter, op4_chat_format, op5_toxicity, op6_media_columns, op7_decontaminate, op8_html_extract, op9_best_fit_packing, op10_jaccard_join, op11_ranked_search, op12_line_dedup, op13_name_join)}


def _license_sql() -> str:
    """The scan over ``documents`` as one statement; ids are unique there."""
    rows, vocabulary = licenses.template_rows(licenses.TEMPLATES)
    listed = lambda x: "[" + ", ".join(f"'{v}'" for v in x) + "]"
    words = r"list_filter(string_split_regex(lower(%s), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""WITH t(template, license, term, tf) AS (VALUES {', '.join(map(str, rows))}),
 d AS (SELECT doc_id, coalesce(text, '') AS body, {words % "coalesce(text, '')"} AS w, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), CASE WHEN doc_id % 4 <> 0 THEN (doc_id // 100)::VARCHAR END, doc_id || '.txt') AS path FROM documents),
 n AS (SELECT count(*) AS n FROM d), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_intersect(list_distinct(w), {listed(vocabulary)})) AS term FROM d) GROUP BY ALL),
 idf AS (SELECT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM t) LEFT JOIN df USING (term), n),
 tw AS (SELECT template, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS t_w FROM t JOIN idf USING (term)),
 s AS (SELECT doc_id, pos, {words % "parts[pos]"} AS w FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, string_split_regex(body, '[.!?]\\s+|\\n+') AS parts FROM d WHERE list_has_any(w, {listed(licenses.ANCHORS)})))),
 c AS (SELECT doc_id, pos, term, count(*) AS tf FROM (SELECT doc_id, pos, unnest(w) AS term FROM s WHERE list_has_any(w, {listed(licenses.ANCHORS)})) GROUP BY ALL),
 cw AS (SELECT doc_id, pos, term, tf, tf * coalesce(idf, ln((n + 1) / 1) + 1) AS w FROM c LEFT JOIN idf USING (term), n),
 size AS (SELECT doc_id, pos, sqrt(sum(w * w)) AS norm, sum(tf) AS words FROM cw GROUP BY ALL),
 dot AS (SELECT doc_id, pos, template, license, sum(w * t_w) AS dot FROM cw JOIN tw USING (term) GROUP BY ALL),
 sec AS (SELECT doc_id, pos, max((round(dot / norm, 6), license)) AS b, any_value(words) AS words FROM dot JOIN size USING (doc_id, pos) GROUP BY ALL),
 own AS (SELECT doc_id, max(b)[1] AS cosine, max(b)[2] AS license, sum(words) AS matched FROM sec WHERE b[1] >= 0.6 GROUP BY ALL),
 j AS (SELECT d.doc_id, path, len(w) AS words, cosine, license, matched, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM d LEFT JOIN own USING (doc_id)),
 dl AS (SELECT dir AS above, max((cosine, license))[2] AS dir_license FROM j WHERE license IS NOT NULL AND matched >= 0.25 * words GROUP BY ALL),
 near AS (SELECT dir, max((depth, above, dir_license)) AS x FROM (SELECT DISTINCT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS above FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS depth FROM j)) JOIN dl USING (above) GROUP BY ALL)
 SELECT doc_id, path, license AS own_license, cosine, coalesce(license, x[3]) AS license, CASE WHEN license IS NULL THEN x[2] END AS inherited_from FROM j LEFT JOIN near USING (dir)"""


_JACCARD_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS sh FROM w),
 n AS (SELECT doc_id, count(sh) AS n, md5(coalesce(string_agg(sh, chr(10) ORDER BY sh), '')) AS own FROM w LEFT JOIN s USING (doc_id) GROUP BY ALL),
 l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
 r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
 c AS (SELECT n.doc_id, n, own, min(b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n, own)
 SELECT doc_id, n AS n_shingles, component_id, count(*) OVER (PARTITION BY component_id) AS class_rows, CASE WHEN n = 0 THEN 1 ELSE count(*) OVER (PARTITION BY own) END AS n_copies FROM c"""


def _leaks_sql() -> str:
    """By the definition, without seeds: equal words of each diagonal, and its best run by running sums, which starts after the last lowest sum."""
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    by = "doc_id, item, off"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT row_number() OVER () AS item, *, len(w) - CASE WHEN len(w) >= {decontaminate.SPAN} THEN len(w) // 5 ELSE 0 END AS enough FROM (SELECT DISTINCT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
 dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d), bw AS (SELECT item, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM b),
 x AS (SELECT doc_id, item, dw.p - bw.p AS off, count(*) AS same, min(dw.p) AS same_first, max(dw.p) AS same_last FROM dw JOIN bw USING (word) GROUP BY ALL),
 r AS (SELECT x.*, item_id, enough, d.w AS dw, b.w AS iw FROM x JOIN b USING (item) JOIN d USING (doc_id) WHERE same >= least(13, enough)),
 p AS (SELECT {by}, q, (dw[q + 1] = iw[q - off + 1])::INT AS m FROM (SELECT *, unnest(range(greatest(0, off), least(len(dw), len(iw) + off))) AS q FROM r)),
 c AS (SELECT *, sum(3 * m - 2) OVER w AS s, sum(m) OVER w AS n FROM p WINDOW w AS (PARTITION BY {by} ORDER BY q ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT *, max((3 * m - 2 - s, q, n - m)) OVER (PARTITION BY {by} ORDER BY q ROWS UNBOUNDED PRECEDING) AS low FROM c),
 g AS (SELECT {by}, s + low[1] AS score, n - low[3] AS matches, low[2] AS first, q AS last, row_number() OVER (PARTITION BY {by} ORDER BY s + low[1] DESC, q) AS best FROM f),
 o AS (SELECT doc_id, item_id, CASE WHEN score >= 10 AND matches >= 13 THEN (matches, -first, last) WHEN same >= enough THEN (same, -same_first, same_last) END AS o FROM r JOIN g USING (doc_id, item, off) WHERE best = 1)
 SELECT doc_id, item_id, x[1]::BIGINT AS matches, (-x[2])::BIGINT AS first_word, x[3]::BIGINT AS last_word FROM (SELECT doc_id, item_id, max(o) AS x FROM o WHERE o IS NOT NULL GROUP BY ALL)"""


# windows are cut by a recursion over the turns of each conversation: p and c are running sums of tokens and written characters
_CHAT_SQL = r"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, role, coalesce(text, '') AS text FROM (SELECT * FROM conversations UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r))),
 k AS (SELECT *, pos = 0 AND role = 'system' AS sys, (length(text) + 3) // 4 + 4 AS tokens, length(role) + 6 + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 8 AS chars FROM t),
 conv AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, coalesce(sum(tokens) FILTER (sys), 0)::BIGINT AS fixed, coalesce(sum(chars) FILTER (sys), 0)::BIGINT AS head,
  coalesce(list(tokens ORDER BY pos) FILTER (NOT sys), []) AS tok, coalesce(list(chars ORDER BY pos) FILTER (NOT sys), []) AS chr FROM k GROUP BY ALL),
 s AS (SELECT *, list_transform(range(0, len(tok) + 1), lambda i: coalesce(list_sum(tok[1:i]), 0)::BIGINT) AS p, list_transform(range(0, len(chr) + 1), lambda i: coalesce(list_sum(chr[1:i]), 0)::BIGINT) AS c FROM conv),
 w AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS start, 0::BIGINT AS ctx, 0::BIGINT AS wins, 0::BIGINT AS done FROM s UNION ALL
  SELECT conv_id, i + 1, CASE WHEN cut THEN nxt ELSE start END, CASE WHEN cut THEN i - nxt ELSE ctx END, wins + cut::INT, done + CASE WHEN cut THEN head + c[i + 1] - c[start + 1] ELSE 0 END FROM
  (SELECT *, CASE WHEN least(128, 512 - fixed - tok[i + 1]) > 0 THEN coalesce(list_filter(range(start, i + 1), lambda j: p[i + 1] - p[j + 1] <= least(128, 512 - fixed - tok[i + 1]))[1], i) ELSE i END AS nxt FROM
   (SELECT w.*, s.tok, s.p, s.c, s.fixed, s.head, i - start > ctx AND fixed + p[i + 1] - p[start + 1] + tok[i + 1] > 512 AS cut FROM w JOIN s USING (conv_id) WHERE i < len(s.tok)))),
 e AS (SELECT w.* FROM w JOIN s USING (conv_id) WHERE i = len(tok))
 SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (done + head + c[i + 1] - c[start + 1])::BIGINT AS formatted_chars, (wins + 1)::BIGINT AS n_windows FROM e JOIN s USING (conv_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the licence scan, chat formatting, decontamination, the n-gram join, ranked search and line dedup; the others are held against brute force in the tests."""
    return {"op1_license_scan": _license_sql(), "op4_chat_format": _CHAT_SQL, "op7_decontaminate": _leaks_sql(), "op10_jaccard_join": _JACCARD_SQL, "op11_ranked_search": search.SQL, "op12_line_dedup": lines.SQL}
