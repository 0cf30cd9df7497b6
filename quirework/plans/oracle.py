"""The same results in DuckDB's SQL, written apart from the Spark code."""

from __future__ import annotations

from ..functions.text import CHAPTER_WORDS

#: Common tables. Lines of documents; words of conversations, wrapped to pages; invented boxes.
LINES = "dl AS (SELECT doc_id, source, text AS doc, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
SIGNED = f"{LINES}, sg AS (SELECT doc_id, source, CAST(line_no AS INTEGER) AS line_no, text, regexp_replace(lower(text), '[^\\p{{L}}]', '', 'g') AS signature FROM dl)"
REPEATED = (
    f"{SIGNED}, np AS (SELECT source, count(DISTINCT doc_id) AS n_pages FROM documents GROUP BY source), "
    "rp AS (SELECT source, signature, count(DISTINCT doc_id) AS n, any_value(n_pages) AS n_pages FROM sg JOIN np USING (source) WHERE strlen(signature) >= 8 GROUP BY source, signature "
    "HAVING any_value(n_pages) >= 4 AND count(DISTINCT doc_id) >= greatest(ceil(any_value(n_pages) * 0.1), 2))"
)
WORDS = (
    "cs AS (SELECT conv_id, turn, string_split_regex(text, '\\s+') AS w FROM conversations), "
    "cw AS (SELECT conv_id, turn, unnest(w) AS text, generate_subscripts(w, 1) AS pos FROM cs), "
    "cn AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS n FROM cw WHERE text <> ''), "
    "ww AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(n // 60 AS INTEGER) AS page_index, CAST((n // 10) % 6 AS INTEGER) AS line_no, CAST(n % 10 AS INTEGER) AS i, text FROM cn)"
)
SYN = (
    f"{WORDS}, wo AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_index, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM ww), "
    "wx AS (SELECT *, CAST(36 + 3 * o + CASE WHEN page_index % 2 = 1 AND i >= 5 THEN 150 ELSE 0 END + CASE WHEN line_no % 3 = 0 THEN 9 ELSE 0 END AS DOUBLE) AS x0, CAST(72 + 14 * line_no + CASE WHEN line_no >= 4 THEN 10 ELSE 0 END AS DOUBLE) AS y0 FROM wo), "
    "sw AS (SELECT *, line_no * 10 + i AS word_no, x0 + 3 * length(text) AS x1, y0 + 12 AS y1, line_no = 0 AS bold FROM wx)"
)
SYN_LINES = (
    f"{SYN}, sl AS (SELECT doc_id, page_index, line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, bool_or(bold) AS bold, CAST(count(*) AS INTEGER) AS n_words, "
    "string_agg(text, ' ' ORDER BY word_no) AS text, arg_min(text, word_no) AS first_word, arg_max(text, word_no) AS last_word FROM sw GROUP BY ALL)"
)
SYN_LINES = SYN_LINES.replace("GROUP BY ALL", "GROUP BY doc_id, page_index, line_no")
STATS = (
    f"{SYN_LINES}, run AS (SELECT doc_id, page_index, x0, count(*) OVER f AS k, avg(x0) OVER f AS m FROM sl WINDOW f AS (PARTITION BY doc_id, page_index ORDER BY x0 RANGE BETWEEN 4.2 PRECEDING AND CURRENT ROW)), "
    "mode AS (SELECT doc_id, page_index, arg_max(m, k * 100000 - x0) AS margin FROM run GROUP BY doc_id, page_index), "
    "steps AS (SELECT doc_id, page_index, line_no, y0 - lag(y0) OVER (PARTITION BY doc_id, page_index ORDER BY line_no) AS step FROM sl), "
    "lead_ AS (SELECT doc_id, page_index, CASE WHEN count(*) = 1 THEN 1.2::DOUBLE * 12 ELSE coalesce(median(step) FILTER (step > 0), 12.0) END AS \"leading\" FROM steps GROUP BY doc_id, page_index), "
    "edge AS (SELECT doc_id, page_index, list_sort(list(x1)) AS v FROM sl GROUP BY doc_id, page_index), "
    "st AS (SELECT doc_id, page_index, 12.0::DOUBLE AS column_font, margin, v[CAST(round((len(v) - 1) * 0.9) AS INTEGER) + 1] AS right_edge, \"leading\" FROM edge JOIN mode USING (doc_id, page_index) JOIN lead_ USING (doc_id, page_index))"
)
ENDS = """[.!?:;…]["''»”’)\\]\\s]*$"""
PARAGRAPHS = (
    f"{STATS}, ln AS (SELECT sl.*, column_font AS fs, margin, right_edge, \"leading\", x0 - margin AS lg, right_edge - x1 AS rg, greatest(right_edge - margin, 1.0) AS measure FROM sl JOIN st USING (doc_id, page_index)), "
    "lf AS (SELECT *, x1 >= right_edge - 2 * fs AS reach, abs(rg) < 1.5 * fs AND lg > 0.3 * measure AS ra, right(last_word, 1) IN ('-', '‐', '‑', chr(2), '­', '¬') AS hy, abs(lg - rg) < measure * 0.12 AND lg > 1.5 * fs AND rg > 1.5 * fs AS ce FROM ln), "
    "lp AS (SELECT *, lag(reach) OVER p AS preach, lag(hy) OVER p AS phy, lag(y0) OVER p AS py, lag(ra) OVER p AS pra FROM lf WINDOW p AS (PARTITION BY doc_id, page_index ORDER BY line_no)), "
    "pn AS (SELECT *, sum(CASE WHEN py IS NULL OR (x0 > margin + 0.55 * fs AND NOT (ce AND preach)) OR (NOT preach AND NOT phy) OR y0 - py > 1.55 * \"leading\" OR ra OR pra THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_index ORDER BY line_no) - 1 AS para_no FROM lp)"
)
_ext = "SELECT doc_id, page_index, min(x0) AS bx0, max(x1) AS bx1, min(y0) AS by0, max(y1) AS by1, count(*) AS n_words, greatest(median(y1 - y0), 1.0) AS mh FROM sw GROUP BY doc_id, page_index"
OCCUPIED = (
    f"{SYN}, ex AS ({_ext}), cl AS (SELECT doc_id, page_index, CAST(least(greatest(floor(((y0 + y1) / 2 - by0) / mh), 0), least(greatest(ceil((by1 - by0) / mh), 1), 4096) - 1) AS INTEGER) AS r, "
    "CAST(least(greatest(floor((x0 - bx0) / ((bx1 - bx0) / 300)), 0), 299) AS INTEGER) AS a, CAST(least(greatest(floor((x1 - bx0) / ((bx1 - bx0) / 300)), 0), 299) AS INTEGER) AS b FROM sw JOIN ex USING (doc_id, page_index)), "
    "ce AS (SELECT DISTINCT doc_id, page_index, r, unnest(generate_series(a, b)) AS bin FROM cl), oc AS (SELECT doc_id, page_index, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM ce GROUP BY doc_id, page_index, bin)"
)
GUTTERS = (
    f"{OCCUPIED}, rc AS (SELECT doc_id, page_index, count(DISTINCT r) AS n_rows FROM cl GROUP BY doc_id, page_index), "
    "ev AS (SELECT ex.*, n_rows, unnest(generate_series(0, 299)) AS bin FROM ex JOIN rc USING (doc_id, page_index) WHERE n_words >= 16 AND bx1 > bx0 AND by1 > by0), "
    "em AS (SELECT ev.*, ev.bin - row_number() OVER (PARTITION BY ev.doc_id, ev.page_index ORDER BY ev.bin) AS isl FROM ev LEFT JOIN oc ON oc.doc_id = ev.doc_id AND oc.page_index = ev.page_index AND oc.bin = ev.bin WHERE coalesce(oc.n, 0) <= floor(n_rows * 0.15)), "
    "rn AS (SELECT doc_id, page_index, isl, min(bin) AS a, max(bin) AS b, any_value(bx0) AS bx0, any_value(bx1) AS bx1, any_value(mh) AS mh FROM em GROUP BY doc_id, page_index, isl), "
    "gt AS (SELECT doc_id, page_index, bx0 + (a + b + 1) / 2 * ((bx1 - bx0) / 300) AS gutter FROM rn WHERE b - a + 1 >= greatest(ceil(greatest(1.5 * mh, 0.02 * (bx1 - bx0)) / ((bx1 - bx0) / 300)), 2) AND a > 24 AND b + 1 < 276)"
)
PLAN = (
    f"{GUTTERS}, pg AS (SELECT ex.doc_id, ex.page_index, bx0, bx1, coalesce(list_sort(list(gutter) FILTER (gutter IS NOT NULL)), []::DOUBLE[]) AS g FROM ex LEFT JOIN gt USING (doc_id, page_index) WHERE bx1 > bx0 GROUP BY ex.doc_id, ex.page_index, bx0, bx1), "
    "vt AS (SELECT doc_id, len(g) AS k, count(*) AS n FROM pg GROUP BY doc_id, len(g)), wn AS (SELECT doc_id, CAST(arg_max(k, n * 1000 - k) AS INTEGER) AS cnt FROM vt GROUP BY doc_id)"
)
ITEMS = (
    f"{WORDS}, wl AS (SELECT doc_id, page_index, line_no, string_agg(text, ' ' ORDER BY i) AS text FROM ww GROUP BY doc_id, page_index, line_no), "
    "wl2 AS (SELECT *, right(text, 1) IN ('-', '‐', '‑') AS hy, lead(text) OVER (PARTITION BY doc_id, page_index ORDER BY line_no) AS nx FROM wl), "
    "wp AS (SELECT doc_id, page_index, count(*) AS n_lines, regexp_replace(regexp_replace(trim(string_agg(CASE WHEN nx IS NULL THEN text WHEN hy AND regexp_extract(nx, '\\p{L}') <> '' AND lower(regexp_extract(nx, '\\p{L}')) = regexp_extract(nx, '\\p{L}') THEN left(text, length(text) - 1) ELSE text || ' ' END, '' ORDER BY line_no)), '\\s+', ' ', 'g'), ' ([,.;:!?’])', '\\1', 'g') AS text FROM wl2 GROUP BY doc_id, page_index), "
    f"wi AS (SELECT *, regexp_matches(text, '{ENDS}') AS ends FROM wp), "
    "wc AS (SELECT *, coalesce(NOT lag(ends) OVER b AND lag(n_lines) OVER b >= 5, false) AS continues FROM wi WINDOW b AS (PARTITION BY doc_id ORDER BY page_index)), "
    "wg AS (SELECT *, sum(CASE WHEN continues THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_index) AS group_no FROM wc)"
)
BOOK = (
    f"{LINES}, bk AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(line_no AS INTEGER) AS block_no, CASE WHEN line_no % 7 = 3 THEN 'heading' WHEN line_no % 5 = 2 THEN 'page_break' ELSE 'text' END AS kind, CAST(1 + line_no % 2 AS INTEGER) AS lv, text, source, CAST(line_no % 20 AS VARCHAR) AS label FROM dl), "
    "bc AS (SELECT *, sum(CASE WHEN (kind = 'heading' AND lv = 1) OR block_no = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS chapter_no FROM bk)"
)
TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
YAML = """CASE WHEN {0} = '' OR contains({0}, ':') OR contains({0}, '#') OR regexp_matches({0}, '^[\\[{{&*!|>''"%@`]') OR regexp_replace({0}, '^\\s+|\\s+$', '', 'g') <> {0} THEN '"' || replace(replace({0}, '\\', '\\\\'), '"', '\\"') || '"' ELSE {0} END"""
_labelled = "CASE WHEN p_partkey % 6 = 0 THEN 'Chapter ' || p_name WHEN p_partkey % 6 = 1 THEN 'XIV.' WHEN p_partkey % 6 = 2 THEN p_partkey || ' -' WHEN p_partkey % 6 = 3 THEN '  Bölüm ' || p_partkey WHEN p_partkey % 6 = 4 THEN repeat(p_name, 9) ELSE p_name END"
_edited = (
    "CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN 'zz' || substr(text, 3) WHEN 2 THEN text || ' and more' WHEN 3 THEN left(text, length(text) // 2) WHEN 4 THEN 'new words at the start, ' || substr(text, 2) ELSE reverse(text) END"
)
_mark = "CASE WHEN line_no % 3 = 0 THEN '# ' WHEN line_no % 3 = 1 THEN '\"<&' ELSE '' END || text"
_pct = "CAST(CAST(round_even({0} * 100, 0) AS INTEGER) AS VARCHAR)"
_digits = "regexp_replace(t, '[^0-9]', '', 'g')"

_hl = (
    "pk AS (SELECT p_partkey AS k, p_partkey, p_name FROM part), pj AS (SELECT *, CAST(k // 20 AS VARCHAR) AS doc_id, CAST(k % 20 AS INTEGER) AS i, CAST((k % 20) // 5 AS INTEGER) AS block, CAST((k % 20) % 5 AS INTEGER) AS j FROM pk), "
    "pt AS (SELECT *, CASE WHEN j > 0 THEN -1 ELSE (k // 20 + block) % 4 END AS kind FROM pj), "
    "hl AS (SELECT doc_id, i, j, block, kind, CASE WHEN kind = 2 THEN 'Chapter ' || p_partkey ELSE p_name END AS text, CASE WHEN kind IN (1, 2, 3) THEN 200.0 ELSE 30.0 END AS x0, CASE WHEN kind = 0 THEN 150.0 WHEN kind IN (1, 2, 3) THEN 300.0 ELSE 470.0 END AS x1, "
    "100.0 + 20 * i + 30 * block + CASE WHEN j > 0 THEN 12 ELSE 0 END AS y0, CASE WHEN kind = 3 THEN 8.0 ELSE 12.0 END AS fs FROM pt)"
)
HEADINGS = (
    f"{_hl}, hs AS (SELECT doc_id, median(fs) AS fs, mode(x0) AS margin, list_sort(list(x1))[CAST(round((count(*) - 1) * 0.9) AS INTEGER) + 1] AS edge FROM hl GROUP BY doc_id), "
    "hd AS (SELECT doc_id, median(step) AS lead_ FROM (SELECT doc_id, y0 - lag(y0) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM hl) WHERE step > 0 GROUP BY doc_id), "
    "hp AS (SELECT doc_id, block * 2 + CASE WHEN j > 0 THEN 1 ELSE 0 END AS para_no, count(*) AS n, string_agg(text, ' ' ORDER BY i) AS text, min(y0) AS y0, max(y0) AS y_last, min(x0) AS x0, max(x1) AS x1, min(fs) AS own, bool_or(kind = 0) AS bold FROM hl GROUP BY ALL), "
    "hg AS (SELECT hp.*, hs.fs AS fs, margin, greatest(edge - margin, 1.0) AS measure, x0 - margin AS lg, edge - x1 AS rg, "
    "coalesce(y0 - lag(y_last) OVER w > 1.4 * lead_, true) AS before, coalesce(lead(y0) OVER w - y0 > 1.25 * lead_, true) AS after_ FROM hp JOIN hs USING (doc_id) JOIN hd USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY para_no)), "
    "hc AS (SELECT *, abs(lg - rg) < 0.12 * measure AND lg > 1.5 * fs AND rg > 1.5 * fs AS mid FROM hg)"
)
_fk = (
    "fk AS (SELECT p_partkey AS k, p_name FROM part), fp AS (SELECT *, CAST(k // 60 AS VARCHAR) AS doc_id, CAST((k % 60) // 12 AS INTEGER) AS page_index, CAST(k % 12 AS INTEGER) AS line_no FROM fk), "
    "fl AS (SELECT *, CASE WHEN line_no = 0 THEN 'header' WHEN line_no = 11 THEN 'number' WHEN line_no = 1 AND page_index = 1 THEN 'rule' WHEN line_no = 10 AND page_index = 2 THEN 'note' ELSE 'body' END AS kind FROM fp), "
    "fb AS (SELECT doc_id, count(DISTINCT page_index) AS n_pages FROM fl GROUP BY doc_id), "
    "fr AS (SELECT fl.*, CASE kind WHEN 'header' THEN 'The Running Title of a Book' WHEN 'number' THEN CAST(page_index + 41 AS VARCHAR) WHEN 'rule' THEN '_' WHEN 'note' THEN 'note' ELSE p_name END AS text, "
    # A header repeats from four pages on; what stands above a page's rule is furniture, whatever it is.
    "CASE WHEN kind = 'rule' OR kind = 'note' THEN 'Chrome' WHEN kind = 'header' AND max(CASE WHEN kind = 'rule' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_index) = 1 THEN 'Chrome' WHEN kind = 'header' AND n_pages >= 4 THEN 'RunningHeader' WHEN kind = 'number' THEN 'PageNumber' END AS reason FROM fl JOIN fb USING (doc_id)), "
    "fs AS (SELECT doc_id, page_index, line_no, reason, CASE WHEN kind = 'rule' THEN '(rule of 480 pt)' ELSE text END AS shown, max(CASE WHEN reason = 'PageNumber' THEN text END) OVER (PARTITION BY doc_id, page_index) AS printed_label FROM fr)"
)
_boxes = (
    "bq AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, CAST(l_linenumber AS DOUBLE) AS n FROM lineitem), bx AS (SELECT l_orderkey, l_linenumber, q, n, least(q * 10, n * 80) AS x0, greatest(q * 10, n * 80) AS x1, least(n * 100, q * 12) AS y0, greatest(n * 100, q * 12) AS y1 FROM bq), "
    "bs AS (SELECT *, greatest(0.6 * CASE WHEN n % 4 > 0 THEN least(q % 7, n % 4) ELSE q % 7 END, 0.5) AS half, (y0 + y1) / 2 AS middle FROM bx)"
)
_glyphs = (
    "gc AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c, generate_subscripts(string_split(p_name, ''), 1) - 1 AS i FROM part), gn AS (SELECT *, p_partkey * 1000 + i AS no FROM gc), "
    "gu AS (SELECT CAST(p_partkey // 10 AS VARCHAR) AS doc_id, no AS glyph_no, c = ' ' AND no % 17 <> 0 AND no % 19 <> 0 AS blank, CASE WHEN no % 11 = 0 THEN 1.0 ELSE 8.0 + p_partkey % 3 END AS size FROM gn "
    "WHERE NOT (no % 19 = 0 AND no % 17 <> 0) AND ((c = ' ' AND no % 17 <> 0) OR (no % 11 <> 0 AND no % 13 <> 0))), "
    "gm AS (SELECT doc_id, greatest(coalesce(median(size) FILTER (NOT blank), 0), 1) AS med, count(*) FILTER (blank) * 12 < count(*) FILTER (NOT blank) AS missing FROM gu GROUP BY doc_id)"
)
_choice = "CASE WHEN n >= 120 THEN 'Text' WHEN n = 0 THEN 'Ocr' ELSE 'Compare' END"

SQL: dict[str, str] = {
    "syn_headings": f"WITH {HEADINGS} SELECT doc_id, 0 AS page_index, CAST(para_no AS BIGINT) AS para_no, CAST(n AS INTEGER) AS n_lines, text, x0 > margin + 0.55 * fs AS starts_indented, CAST(coalesce(CASE WHEN n > 1 OR x1 - x0 >= 0.85 * measure THEN NULL WHEN bold AND before AND after_ THEN 2 WHEN own < 0.75 * fs THEN NULL WHEN mid AND (before OR after_) THEN CASE WHEN starts_with(text, 'Chapter ') THEN 1 ELSE 2 END END, 0) AS INTEGER) AS heading_level FROM hc",
    "syn_strip": f"WITH {_fk} SELECT doc_id, page_index, line_no, reason, shown, printed_label FROM fs",
    "strip_summary": f"WITH {_fk} SELECT CASE WHEN reason = 'PageNumber' THEN '(page numbers)' ELSE shown END AS text, reason, count(*) AS n FROM fs WHERE reason IS NOT NULL GROUP BY ALL",
    "geometry_boxes": f"WITH {_boxes} SELECT l_orderkey, l_linenumber, x0, y0, x1, y1, x1 - x0 AS width, y1 - y0 AS height, (x0 + x1) / 2 AS centre, least(x1, 300.0) - greatest(x0, 100.0) AS overlap, 800.0::DOUBLE - y0 AS flipped, round(middle - half, 6) AS band_top, round(middle + half, 6) AS band_bottom, l_orderkey % 900 >= 600 AS bold, CASE WHEN l_linenumber > 3 THEN 'iv' ELSE CAST(l_linenumber + 1 AS VARCHAR) END AS label, y0 <= 80 AS in_top, y1 >= 450 AS in_bottom FROM bs",
    "robust_stats": "WITH v AS (SELECT l_orderkey, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem), m AS (SELECT l_orderkey, median(v) AS m FROM v GROUP BY l_orderkey), o AS (SELECT v.*, abs(v - m) AS off_ FROM v JOIN m USING (l_orderkey)), d AS (SELECT l_orderkey, median(off_) AS mad FROM o GROUP BY l_orderkey) SELECT l_orderkey, round(any_value(mad), 4) AS mad, round(median(v) FILTER (mad <= 0 OR off_ <= 4 * mad), 4) AS typical FROM o JOIN d USING (l_orderkey) GROUP BY l_orderkey",
    "usable_glyphs": f"WITH {_glyphs} SELECT doc_id, glyph_no, blank, round(CAST(med AS DOUBLE), 4) AS med, round(CAST(med AS DOUBLE) * CASE WHEN missing THEN 0.28 ELSE 1.1 END, 4) AS gap_limit FROM gu JOIN gm USING (doc_id)",
    "decision_totals": f"WITH x AS (SELECT source, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END AS n FROM documents), y AS (SELECT source, {_choice} AS d FROM x) SELECT source, count(*) FILTER (d = 'Text') AS text, count(*) FILTER (d = 'Ocr') AS ocr, count(*) FILTER (d = 'Compare') AS compare, count(*) FILTER (d = 'Empty') AS empty FROM y GROUP BY source",
    "settled_pages": f"WITH x AS (SELECT source, CAST(doc_id AS INTEGER) AS p, coalesce(text, '') AS t, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END AS n FROM documents), y AS (SELECT *, {_choice} AS d, CASE WHEN p % 10 <> 0 THEN length(t) END AS a, CASE WHEN p % 3 <> 0 THEN CASE WHEN p % 2 = 0 THEN 2 * length(t) ELSE length(left(t, 5)) END END AS b FROM x), "
    "z AS (SELECT *, CASE d WHEN 'Ocr' THEN coalesce(b, 0) > 0 WHEN 'Compare' THEN coalesce(b, 0) > greatest(coalesce(a, 0) * 1.5, 1) ELSE false END AS won FROM y) SELECT source AS source_name, p AS page_index, CASE WHEN won THEN 'Ocr' ELSE 'Text' END AS source, CASE WHEN won THEN b ELSE a END AS chars FROM z WHERE CASE WHEN won THEN b ELSE a END IS NOT NULL",
    "cached_corrections": f"WITH {LINES}, k AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, text, sha256(sha256('1' || chr(0) || 'prompt') || chr(0) || text) AS key FROM dl WHERE trim(text) <> ''), c AS (SELECT DISTINCT key, 'fixed: ' || text AS reply FROM k WHERE line_no % 2 = 0) SELECT doc_id, line_no, key, reply IS NOT NULL AS cached, coalesce(reply, text) AS text FROM k LEFT JOIN c USING (key)",
    "normalise_spaces": f"SELECT doc_id, regexp_replace(regexp_replace({TRIM.format(chr(39).join(['replace(text, ', ', ', ', ', '  , ', ')']))}, '\\s+', ' ', 'g'), ' ([,.;:!?’])', '\\1', 'g') AS clean FROM documents",
    "line_signature": f"WITH {SIGNED} SELECT doc_id, line_no, signature FROM sg",
    "repeated_lines": f"WITH {REPEATED} SELECT source, signature, n FROM rp",
    "drop_repeated_lines": f"WITH {REPEATED} SELECT doc_id, line_no, (source, signature) IN (SELECT (source, signature) FROM rp) AS dropped FROM sg",
    "dropped_summary_topk": f"WITH {REPEATED}, gone AS (SELECT text, {_digits.replace('t,', 'text,', 1)} AS d FROM sg WHERE (source, signature) IN (SELECT (source, signature) FROM rp)) SELECT text, 'RunningHeader' AS reason, count(*) AS n FROM gone GROUP BY text ORDER BY n DESC, text LIMIT 30",
    "page_number_lines": f"WITH x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '- ' || doc_id || ' -' WHEN 1 THEN 'page ' || doc_id WHEN 2 THEN '·' || doc_id || '.....' WHEN 3 THEN ' ' || (doc_id + 99000) || ' ' ELSE '*' END AS t FROM documents) SELECT doc_id, CASE WHEN length({_digits}) BETWEEN 1 AND 5 AND NOT regexp_matches(t, '\\p{{L}}') AND length(regexp_replace(t, '\\s', '', 'g')) <= length({_digits}) + 4 THEN {_digits} END AS label FROM x",
    "sentence_end_flags": f"WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_matches(text, '{ENDS}') AS ends_sentence FROM dl",
    "suspicious_lines": f"WITH {LINES}, tk AS (SELECT doc_id, line_no, text, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM dl) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_matches(text, '[·¬|~^�]') OR coalesce(list_max(list_transform(w, lambda x: length(x))), 0) > 24 OR (len(w) >= 8 AND len(list_filter(w, lambda x: length(x) = 1)) * 5 > len(w)) AS suspicious FROM tk",
    "chapter_labels": f"WITH x AS (SELECT p_partkey, {TRIM.format(_labelled)} AS t FROM part), y AS (SELECT *, regexp_replace(t, '[.):—– -]+$', '') AS core FROM x) SELECT p_partkey, length(t) BETWEEN 1 AND 60 AND core <> '' AND (regexp_matches(core, '^[0-9]+$') OR regexp_matches(core, '^[IVXLC]{{1,8}}$') OR {' OR '.join(f'starts_with(lower(t), {w!r})' for w in CHAPTER_WORDS)}) AS is_label FROM y",
    "separator_lines": "WITH x AS (SELECT p_partkey, regexp_replace(CASE p_partkey % 5 WHEN 0 THEN '* * *' WHEN 1 THEN '--' WHEN 2 THEN ' _ __ ' WHEN 3 THEN '-*-' ELSE repeat('-', CAST(p_partkey % 7 AS INTEGER)) END, '\\s', '', 'g') AS t FROM part) SELECT p_partkey, length(t) >= 3 AND (ltrim(t, '*') = '' OR ltrim(t, '-') = '' OR ltrim(t, '_') = '') AS is_separator FROM x",
    "hyphen_kinds": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'literal' WHEN 1 THEN 'explicit' WHEN 2 THEN 'literal' END AS kind FROM part",
    "drift_reasons": f"WITH {LINES}, pr AS (SELECT doc_id, line_no, {TRIM.format('text')} AS a, {TRIM.format(_edited)} AS b FROM dl WHERE strlen(text) = length(text) AND length(text) >= 20) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN b = '' THEN 'empty' WHEN length(b) > length(a) AND (starts_with(b, a) OR ends_with(b, a)) THEN 'only adds text at the start or end' WHEN levenshtein(a, b) <= 4 THEN NULL WHEN abs(length(b) - length(a)) / length(a) > 0.15 THEN 'length changed by ' || {_pct.format('(abs(length(b) - length(a)) / length(a))')} || '%' WHEN 1 - levenshtein(a, b) / greatest(length(a), length(b)) < 0.9 THEN 'only ' || {_pct.format('(1 - levenshtein(a, b) / greatest(length(a), length(b)))')} || '% similar to the original' END AS reason FROM pr",
    "markup_functions": f"WITH {LINES}, m AS (SELECT doc_id, line_no, source, {_mark} AS t FROM dl) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN starts_with(t, '#') THEN '\\' || t ELSE t END AS inline, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS xml, {YAML.format('t')} AS yaml, CASE WHEN length(replace(t, '`', '''')) > 110 THEN left(replace(t, '`', ''''), 107) || '…' ELSE replace(t, '`', '''') END AS short, 'n' || doc_id || '_' || source AS id, '<!-- page: ' || doc_id || ' -->' AS marker FROM m",
    "text_line_stats": f"WITH {LINES} SELECT source, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(max(length(text)) AS INTEGER) AS longest, count(DISTINCT doc_id) AS pages FROM dl GROUP BY source",
    "page_decisions": "WITH x AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END AS n FROM documents) SELECT doc_id, CASE WHEN n >= 120 THEN 'Text' WHEN n = 0 THEN 'Ocr' ELSE 'Compare' END AS auto, 'Ocr' AS always, CASE WHEN n > 0 THEN 'Text' ELSE 'Empty' END AS never, doc_id > greatest(n * 1.5, 1) AS ocr_wins FROM x",
    "page_range_scan": "WITH e AS (SELECT conv_id AS doc_id, turn AS page_index, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) SELECT doc_id, page_index FROM e WHERE page_index BETWEEN least(2, m) AND least(5, m)",
    "language_lookup": "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' END AS language_label, CASE WHEN lang IN ('en', 'fr', 'de') THEN lang ELSE 'und' END AS language FROM documents",
    "cropped_words": f"WITH {SYN} SELECT doc_id, page_index, count(*) FILTER (NOT ins) AS dropped, count(*) FILTER (ins) AS kept FROM (SELECT *, (x0 + x1) / 2 BETWEEN 612.0 * 0.1 AND 612.0 AND y0 >= 792.0 * 0.1 AND y1 <= 792.0 AS ins FROM sw) GROUP BY doc_id, page_index",
    "syn_words": f"WITH {SYN} SELECT doc_id, page_index, word_no, text, x0, y0, x1, y1 FROM sw",
    "syn_line_bbox": f"WITH {SYN_LINES} SELECT doc_id, page_index, line_no, x0, y0, x1, y1, bold, n_words, first_word, last_word FROM sl",
    "syn_column_stats": f"WITH {STATS} SELECT doc_id, page_index, column_font, round(margin, 6) AS margin, right_edge, CAST(\"leading\" AS DOUBLE) AS \"leading\" FROM st",
    "syn_row_occupancy": f"WITH {OCCUPIED} SELECT doc_id, page_index, bin, n FROM oc",
    "syn_candidate_gutters": f"WITH {GUTTERS} SELECT doc_id, page_index, round(gutter, 4) AS gutter FROM gt",
    "syn_column_plan": f"WITH {PLAN}, pl AS (SELECT pg.doc_id, cnt, unnest(list_transform(g, lambda x: (x - bx0) / (bx1 - bx0))) AS place, generate_subscripts(g, 1) AS i FROM pg JOIN wn USING (doc_id) WHERE len(g) = cnt), md AS (SELECT doc_id, i, list_sort(list(place)) AS v FROM pl GROUP BY doc_id, i), ps AS (SELECT doc_id, string_agg(CAST(round(v[len(v) // 2 + 1], 3) AS VARCHAR), ',' ORDER BY i) AS positions FROM md GROUP BY doc_id) SELECT doc_id, cnt AS count, coalesce(positions, '') AS positions FROM wn LEFT JOIN ps USING (doc_id)",
    "syn_column_assign": f"WITH {PLAN}, sl_ AS (SELECT sw.*, len(g) AS k, len(list_filter(g, lambda q: (sw.x0 + sw.x1) / 2 > q)) AS slot FROM sw JOIN pg USING (doc_id, page_index)), sn AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_index, slot) AS m FROM sl_), kp AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_index ORDER BY slot) - 1 AS c FROM sn WHERE k = 0 OR m >= 8) SELECT doc_id, page_index, CAST(c AS INTEGER) AS column_no, count(*) AS n, min(x0) AS x0, max(x1) AS x1 FROM kp GROUP BY doc_id, page_index, c",
    "syn_paragraphs": f"WITH {PARAGRAPHS} SELECT doc_id, page_index, line_no, CAST(para_no AS BIGINT) AS para_no FROM pn",
    "continuing_pages": f"WITH {ITEMS} SELECT doc_id, page_index, continues, CAST(group_no AS BIGINT) AS group_no FROM wg",
    "cross_page_join": f"WITH {ITEMS} SELECT doc_id, count(DISTINCT group_no) AS paragraphs, CAST(0 AS BIGINT) AS headings, count(*) AS page_breaks, CAST(sum(length(text) + CASE WHEN continues THEN 1 ELSE 0 END) AS BIGINT) AS chars FROM wg GROUP BY doc_id",
    "page_markers": f"WITH {ITEMS}, mk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, group_no ORDER BY page_index) AS r FROM wg) SELECT doc_id, CAST(CASE WHEN continues THEN 2 * group_no - 1 ELSE 2 * group_no - 2 END AS BIGINT) AS block_no, CAST(CASE WHEN continues THEN 2 * r - 3 ELSE 0 END AS INTEGER) AS span_no, CAST(page_index + 1 AS VARCHAR) AS label, continues AS inline FROM mk",
    "chapters": f"WITH {BOOK} SELECT doc_id, block_no, CAST(chapter_no AS BIGINT) AS chapter_no, coalesce(max(CASE WHEN kind = 'heading' AND lv = 1 THEN text END) OVER (PARTITION BY doc_id, chapter_no), 'Book: ' || source) AS title FROM bc",
    "page_anchor_dedupe": f"WITH {BOOK} SELECT doc_id, CAST(chapter_no AS BIGINT) AS chapter_no, block_no, 'page_n' || label AS id, label FROM bc WHERE kind = 'page_break' QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY block_no) = 1",
    "plain_text": f"WITH {BOOK} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_no) AS text FROM bk WHERE kind <> 'page_break' GROUP BY doc_id",
    "markdown_export": f"WITH {BOOK}, mb AS (SELECT doc_id, block_no, trim(CASE kind WHEN 'heading' THEN repeat('#', lv) || ' ' || trim(text) WHEN 'page_break' THEN '<!-- page: ' || label || ' -->' ELSE CASE WHEN starts_with(text, '#') THEN '\\' || text ELSE text END END) AS b FROM bk), bd AS (SELECT doc_id, string_agg(b, chr(10) || chr(10) ORDER BY block_no) AS body FROM mb WHERE b <> '' GROUP BY doc_id) SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, '---' || chr(10) || 'title: \"Book: ' || source || '\"' || chr(10) || 'language: ' || lang || chr(10) || 'source: ' || source || chr(10) || 'pages: 7' || chr(10) || '---' || chr(10) || chr(10) || coalesce(body || chr(10) || chr(10), '') AS markdown FROM documents d LEFT JOIN bd ON bd.doc_id = CAST(d.doc_id AS VARCHAR)",
    "ocr_tsv_words": "SELECT l_orderkey, l_linenumber, l_returnflag AS text, round(l_linenumber * 10 * 0.24, 6) AS x0, round(20 * 0.24::DOUBLE, 6) AS y0, round((l_linenumber * 10 + trunc(l_quantity)) * 0.24, 6) AS x1, round(50 * 0.24::DOUBLE, 6) AS y1, round(30 * 0.24::DOUBLE, 6) AS font_size, CASE WHEN l_linenumber <> 3 THEN CAST(trunc(l_quantity) - 5 AS DOUBLE) END AS conf FROM lineitem WHERE l_linenumber <> 2 AND l_quantity <= 45 AND (l_linenumber = 3 OR trunc(l_quantity) >= 5)",
}
