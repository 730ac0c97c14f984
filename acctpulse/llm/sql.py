"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from acctpulse.llm import mixing, quality_rules
from acctpulse.llm.words import GAP

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _quality(docs: str = "documents", then: str = "") -> str:
    """Counts by unnested words, lines and windows; quantiles by counting documents at or below each bucket."""
    rates = list(quality_rules.RATES)
    levels, ends, inside = [], [], ["NOT base_failed"]
    for r, (p, reach, least, both) in quality_rules.RATES.items():
        levels.append(f"('{r}', {p}, {reach}, {least})")
        enough = f"(100 - {p}) >= {100 * quality_rules.MIN_TAIL}"
        for end, inner in (("max", "least"), ("min", "greatest"))[: 1 + both]:
            of = lambda level, c, r=r, end=end: f"max({end}{c}) FILTER (rate = '{r}' AND level = {level})"
            ends.append(
                f"CASE WHEN max(n) FILTER (level = 1) * {enough} THEN {inner}({of(1, '1')}, {of(2, 'b')})"
                f" WHEN max(n) FILTER (level = 2) * {enough} THEN {of(2, '1')} ELSE {of(3, '1')} END AS {r}_{end}"
            )
            inside.append(f"{r} {'<=' if end == 'max' else '>='} {r}_{end}")
    bits = quality_rules.BITS
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, *, {_WORDS} AS ws FROM {docs}),
wins AS (SELECT k, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS w
         FROM d, unnest(range(1, len(ws) - 3)) AS u(i)),
many AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, w) AS c FROM wins) WHERE c > 1),
hit AS (SELECT k, count(DISTINCT i + o) AS n FROM many, range(0, 5) AS r(o) GROUP BY k),
ln AS (SELECT k, count(*) AS n, count(*) - count(DISTINCT l) AS dup
       FROM (SELECT k, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY k),
c AS (SELECT d.k, doc_id, lang, source, len(ws)::BIGINT AS n_words,
        coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
        (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[!?]', '', 'g')))::BIGINT AS marks,
        coalesce(ln.dup, 0)::BIGINT AS n_dup_lines, greatest(coalesce(ln.n, 0), 1) AS lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN hit USING (k) LEFT JOIN ln USING (k)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        1000 * n_symbols // greatest(n_words, 1) AS symbol_rate, 1000 * marks // greatest(n_words, 1) AS mark_rate,
        1000 * n_dup_lines // lines AS line_rate,
        100 * word_chars // greatest(n_words, 1) AS word_length FROM c),
long AS (SELECT lang, source, rate, v, greatest(length(bin(v)) - {bits}, 0) AS sh
         FROM (UNPIVOT (SELECT lang, source, {', '.join(rates)} FROM m WHERE NOT base_failed) ON {', '.join(rates)} INTO NAME rate VALUE v)),
val AS (SELECT lang, source, rate, (v >> sh) << sh AS b FROM long),
lev AS (SELECT 1 AS level, * FROM val UNION ALL SELECT 2, lang, NULL, rate, b FROM val UNION ALL SELECT 3, NULL, NULL, rate, b FROM val),
cum AS (SELECT *, count(*) OVER (PARTITION BY level, lang, source, rate) AS n,
          count(*) OVER (PARTITION BY level, lang, source, rate ORDER BY b) AS upto FROM lev),
rule(rate, p, reach, least) AS (VALUES {', '.join(levels)}),
q AS (SELECT level, lang, source, rate, any_value(reach) AS reach, any_value(least) AS gap, max(n) AS n, min(b) FILTER (100 * upto >= (100 - p) * n) AS lo,
        min(b) FILTER (100 * upto >= 50 * n) AS mid, min(b) FILTER (100 * upto >= p * n) AS hi FROM cum JOIN rule USING (rate) GROUP BY level, lang, source, rate),
f AS (SELECT level, lang, source, rate, n, hi + greatest(gap, reach * (hi - mid)) AS max1, hi + {quality_rules.BOUND} * greatest(gap, reach * (hi - mid)) AS maxb,
        lo - greatest(gap, reach * (mid - lo)) AS min1, lo - {quality_rules.BOUND} * greatest(gap, reach * (mid - lo)) AS minb FROM q),
t AS (SELECT g.lang, g.source, {', '.join(ends)}
      FROM (SELECT DISTINCT lang, source FROM f WHERE level = 1) g JOIN f ON f.level = 3 OR (f.lang IS NOT DISTINCT FROM g.lang
        AND (f.level = 2 OR f.source IS NOT DISTINCT FROM g.source)) GROUP BY g.lang, g.source),
judged AS (SELECT m.*, coalesce({' AND '.join(inside)}, false) AS kept
      FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source)
{then or "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"}"""


def _mixing() -> str:
    """Shares by trying every level at which some source may fill; running sums over whole sources."""
    w = "CAST([1, 2, 3][1 + (rank % 3)::INT] AS DOUBLE)"
    a = "CAST([1.5, 1.0, 0.5][1 + (rank % 3)::INT] AS DOUBLE)"
    repeats = mixing.MAX_REPEATS
    middle = "((e * total + before)::DOUBLE + size / 2.0::DOUBLE)"
    return f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
sw AS (SELECT *, {w} AS weight, {a} AS a, (total * {repeats})::DOUBLE AS cap FROM s),
lv AS (SELECT max(share) AS level FROM (
        SELECT x.weight, x.cap, ((SELECT sum(total) FROM s)::DOUBLE - coalesce(sum(y.cap) FILTER (y.cap / y.weight < x.cap / x.weight), 0))
               / sum(y.weight) FILTER (y.cap / y.weight >= x.cap / x.weight) AS share
        FROM sw x, sw y GROUP BY x.source, x.weight, x.cap) WHERE cap >= share * weight),
g AS (SELECT *, least(cap, (SELECT level FROM lv) * weight) AS target FROM sw),
p AS (SELECT doc_id, size, total, target, a,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
o AS (SELECT *, list_filter([{', '.join(str(k) for k in range(repeats))}], lambda e: size > 0 AND {middle} < target) AS times FROM p),
u AS (SELECT *, CASE WHEN len(times) > 0 THEN (before::DOUBLE + size / 2.0::DOUBLE) / target END AS u FROM o)
SELECT doc_id, size, total AS source_size, target, (size * len(times))::BIGINT AS taken,
       (2.0::DOUBLE * u) / (a + sqrt(a * a + 4.0::DOUBLE * (1.0::DOUBLE - a) * u)) AS first_due FROM u"""


def _decontamination() -> str:
    """Every window at which a document and an item share a shingle, compared by counts of shingles; no fingerprints."""
    words = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    gram = "w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]"
    return f"""
WITH it AS (SELECT item_id, {words} AS w FROM benchmark),
dw AS (SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS key, {words} AS w FROM documents),
ig AS (SELECT item_id, len(w) AS n, i, {gram} AS g FROM it, unnest(range(1, len(w) - 3)) AS u(i)),
dg AS (SELECT doc_id, key, len(w) AS len, i, {gram} AS g FROM dw, unnest(range(1, len(w) - 3)) AS u(i)),
seed AS (SELECT DISTINCT n, i, g FROM ig),
win AS (SELECT DISTINCT doc_id, key, len, n, greatest(0, least(dg.i - seed.i, len - n)) AS start FROM dg JOIN seed USING (g)),
wg AS (SELECT win.doc_id, win.key, win.start, win.n, dg.g, count(*) AS c FROM win JOIN dg ON dg.key = win.key AND dg.doc_id IS NOT DISTINCT FROM win.doc_id
       AND dg.i > win.start AND dg.i + 4 <= win.start + win.n GROUP BY ALL),
size AS (SELECT doc_id, key, start, n, sum(c) AS total FROM wg GROUP BY ALL),
ic AS (SELECT item_id, n, g, count(*) AS c FROM ig GROUP BY ALL),
isz AS (SELECT item_id, sum(c) AS total FROM ic GROUP BY ALL),
common AS (SELECT wg.doc_id, wg.key, wg.start, wg.n, ic.item_id, sum(least(wg.c, ic.c)) AS inter FROM wg JOIN ic ON wg.g = ic.g AND wg.n = ic.n GROUP BY ALL),
sim AS (SELECT common.*, inter / (size.total + isz.total - inter)::DOUBLE AS similarity FROM common
        JOIN size ON size.key = common.key AND size.doc_id IS NOT DISTINCT FROM common.doc_id AND size.start = common.start AND size.n = common.n
        JOIN isz ON isz.item_id = common.item_id)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_max(start, similarity * 1000000000 - start)::INT AS start_word,
       max(n)::INT AS n_words, count(*) AS n_windows FROM sim WHERE similarity >= 0.8 GROUP BY doc_id, key, item_id"""


def _fill_in_middle() -> str:
    """Units as a list by one pattern; parts are slices of that list put together again."""
    draw = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    joined = lambda lo, hi: f"coalesce(array_to_string(u[{lo}:{hi}], ''), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
             regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
k AS (SELECT *, len(u)::BIGINT AS n, {draw(0)} % (len(u) + 1) AS a, {draw(1)} % (len(u) + 1) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {draw(2)} % 100 >= 50 THEN 'plain'
             WHEN {draw(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, {joined("1", "least(a, b)")} AS pre, {joined("least(a, b) + 1", "greatest(a, b)")} AS mid, {joined("greatest(a, b) + 1", "n")} AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p"""


def all_sql() -> dict[str, str]:
    return {"op6_mixing": _mixing(), "op7_decontamination": _decontamination(), "op9_quality_rules": _quality(), "op13_fill_in_middle": _fill_in_middle()}


__all__ = ["GAP", "all_sql"]
