"""DuckDB oracle SQL for the registered queries.

Independent SQL formulations (DuckDB dialect, RE2 regular expressions) of
what the Spark operators compute. The driver runs each string next to the
Spark query on the same parquet tables and compares row count, schema and
values. Derived views (url_corpus, scored_urls, scan_log, labelled_pages)
are inlined as CTEs.
"""

from __future__ import annotations

from linkrisk.constants import (
    DIGIT_CLASS, BRAND_NAMES, FEATURE_COLS, FEATURE_EXPLANATIONS, ALL_FEATURE_COLS, EXTRA_FEATURE_COLS,
    FLAG_RULES, PUBLIC_SUFFIX_SAMPLE, SCHEMES_WITH_PARAMS, SUSPICIOUS_TLDS, SUSPICIOUS_WORDS,
    DOUBLE_FEATURES, BASE_FEATURE_COLS,
)

URL_CORPUS = """url_corpus AS (
SELECT l_orderkey * 10 + l_linenumber AS url_id,
 CASE l_orderkey % 10
  WHEN 0 THEN concat('https://www.google.com/search?q=', CAST(l_partkey AS VARCHAR))
  WHEN 1 THEN concat('https://docs.example.org/en/', CAST(l_suppkey AS VARCHAR), '/', CAST(l_partkey AS VARCHAR))
  WHEN 2 THEN concat('https://shop.example.com/item/', CAST(l_partkey AS VARCHAR), '?ref=', CAST(l_linenumber AS VARCHAR), '&page=', CAST(l_suppkey AS VARCHAR))
  WHEN 3 THEN concat('https://github.com/org', CAST(l_suppkey AS VARCHAR), '/repo/issues/', CAST(l_orderkey AS VARCHAR))
  WHEN 4 THEN concat('http://192.168.', CAST(l_suppkey % 256 AS VARCHAR), '.', CAST(l_linenumber AS VARCHAR), '/secure-login')
  WHEN 5 THEN concat('http://paypa1.com/account/update?id=', CAST(l_orderkey AS VARCHAR))
  WHEN 6 THEN concat('http://paypal-verify.xyz/', CAST(l_suppkey AS VARCHAR), '/confirm')
  WHEN 7 THEN concat('https://google.login', CAST(l_suppkey AS VARCHAR), '.evil.com/signin')
  WHEN 8 THEN concat('http://user', CAST(l_suppkey AS VARCHAR), '@evil.top:8080/a//b')
  ELSE concat('evil', CAST(l_suppkey AS VARCHAR), '.tk/webscr?cmd=', CAST(l_partkey AS VARCHAR), '&x=%20') END AS url,
 CASE WHEN (l_orderkey % 10 >= 4) <> (l_partkey % 40 = 0) THEN 1 ELSE 0 END AS label,
 CAST((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 10000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS u
FROM lineitem)"""

SCORED_URLS = """scored_urls AS (
SELECT url_id, url, label, 0.5E0 * label + 0.5E0 * u AS raw_score FROM url_corpus)"""

SCAN_LOG = """scan_log AS (
SELECT event_id AS scan_id, ts AS scanned_at, user_id, least(value / 1E2, 1E0) AS score,
 CASE WHEN value >= 75 THEN 'Dangerous' WHEN value >= 45 THEN 'Suspicious' ELSE 'Safe' END AS verdict,
 CASE WHEN value >= 45 THEN concat('campaign_', lpad(CAST(user_id % 7 AS VARCHAR), 3, '0')) END AS campaign_id,
 props AS features_json FROM events)"""

def hard_urls_cte() -> str:
    from linkrisk.plans.fixtures import HARD_SHAPES
    cases = " ".join(f"WHEN {i} THEN {_q(a)}" + (f" || CAST(p_partkey AS VARCHAR) || {_q(b)}" if b is not None else "")
                     for i, (a, b) in enumerate(HARD_SHAPES, 1))
    return f"""hard_urls AS (SELECT p_partkey AS url_id, CASE p_partkey % 18 WHEN 0 THEN NULL {cases}
 ELSE 'http:///' || CAST(p_partkey AS VARCHAR) END AS url FROM part)"""


LABELLED_PAGES = """labelled_pages AS (
SELECT p.page_id, p.url, l.toxic AS label FROM pages p JOIN labels l ON p.page_id = l.doc_id)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return ", ".join(_q(x) for x in xs)


def _cnt(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, {_q(ch)}, '')))"


def _digits(x: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{DIGIT_CLASS}', '', 'g')))"


def round_even_sql(x: str, digits: int = 4) -> str:
    """Exact half-even rounding of a DOUBLE (Dekker product error decides ties)."""
    sc = f"{float(10 ** digits)!r}E0" if "e" not in repr(float(10 ** digits)) else repr(float(10 ** digits))
    a = f"abs({x})"
    p = f"({a} * {sc})"
    big = f"(134217729.0E0 * {a})"
    hi = f"({big} - ({big} - {a}))"
    e = f"((({hi} * {sc}) - {p}) + (({a} - {hi}) * {sc}))"
    fl = f"floor({p})"
    fr = f"({p} - {fl})"
    k = (f"(CASE WHEN {fr} > 0.5E0 THEN {fl} + 1 WHEN {fr} < 0.5E0 THEN {fl} WHEN {e} > 0 THEN {fl} + 1 "
         f"WHEN {e} < 0 THEN {fl} WHEN {fl} % 2 = 0 THEN {fl} ELSE {fl} + 1 END)")
    return f"(sign({x}) * CAST({k} AS DOUBLE) / {sc})"


def _entropy(x: str) -> str:
    return (f"(CASE WHEN coalesce(length({x}), 0) = 0 THEN 0.0E0 ELSE "
            + round_even_sql(f"list_aggregate(regexp_extract_all({x}, '(?s).'), 'entropy')") + " + 0.0E0 END)")


_SCH = "^[A-Za-z][A-Za-z0-9+.\\-]*:"
from linkrisk.functions.urlparts import bracket_host_regex  # noqa: E402

_V6 = bracket_host_regex()
_IPV4 = "^\\p{Nd}{1,3}(?:\\.\\p{Nd}{1,3}){3}$"


def parts_ctes(src: str, p: str, add_scheme: bool) -> tuple[list[str], str]:
    """CTEs splitting ``src.url`` into ``{p}scheme .. {p}port_num``."""
    s_expr = ("CASE WHEN contains(url, '://') THEN url ELSE 'http://' || url END" if add_scheme else "url")
    c = []
    c.append(f"""{p}a AS (SELECT *, regexp_replace(regexp_replace({s_expr}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g') AS {p}s FROM {src})""")
    c.append(f"""{p}b AS (SELECT * EXCLUDE ({p}s),
 CASE WHEN regexp_matches({p}s, '{_SCH}') THEN lower(regexp_extract({p}s, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) ELSE '' END AS {p}scheme,
 CASE WHEN regexp_matches({p}s, '{_SCH}') THEN regexp_replace({p}s, '{_SCH}', '') ELSE {p}s END AS {p}rest FROM {p}a)""")
    c.append(f"""{p}c AS (SELECT * EXCLUDE ({p}rest),
 CASE WHEN starts_with({p}rest, '//') THEN regexp_extract({p}rest, '(?s)^//([^/?#]*)', 1) ELSE '' END AS {p}netloc,
 CASE WHEN starts_with({p}rest, '//') THEN regexp_extract({p}rest, '(?s)^//[^/?#]*(.*)$', 1) ELSE {p}rest END AS {p}tail FROM {p}b)""")
    c.append(f"""{p}d AS (SELECT * EXCLUDE ({p}tail),
 regexp_extract({p}tail, '(?s)^[^#]*#(.*)$', 1) AS {p}fragment,
 regexp_extract(regexp_extract({p}tail, '(?s)^([^#]*)', 1), '(?s)^([^?]*)', 1) AS {p}path0,
 regexp_extract(regexp_extract({p}tail, '(?s)^([^#]*)', 1), '(?s)^[^?]*\\?(.*)$', 1) AS {p}query,
 regexp_extract({p}netloc, '(?s)([^@]*)$', 1) AS {p}hostinfo FROM {p}c)""")
    hi = f"{p}hostinfo"
    br = f"regexp_extract({hi}, '(?s)^[^\\[]*\\[(.*)$', 1)"
    bhost = f"regexp_extract({br}, '(?s)^([^\\]]*)', 1)"
    bafter = f"regexp_extract({br}, '(?s)^[^\\]]*\\](.*)$', 1)"
    net = f"{p}netloc"
    c.append(f"""{p}e AS (SELECT * EXCLUDE ({p}path0, {p}hostinfo),
 CASE WHEN {p}scheme IN ({_list(SCHEMES_WITH_PARAMS)}) AND contains({p}path0, ';')
      THEN regexp_replace({p}path0, '(?s);[^/]*$', '') ELSE {p}path0 END AS {p}path,
 CASE WHEN contains({hi}, '[') THEN {bhost} ELSE regexp_extract({hi}, '(?s)^([^:]*)', 1) END AS {p}host_raw,
 CASE WHEN contains({hi}, '[') THEN regexp_extract({bafter}, '(?s)^[^:]*:(.*)$', 1)
      ELSE regexp_extract({hi}, '(?s)^[^:]*:(.*)$', 1) END AS {p}port,
 (contains({net}, '[') <> contains({net}, ']')) OR (contains({net}, '[') AND contains({net}, ']') AND NOT regexp_matches(
    regexp_extract(regexp_extract({net}, '(?s)^[^\\[]*\\[(.*)$', 1), '(?s)^([^\\]]*)', 1), '{_V6}')) AS {p}bad_netloc
 FROM {p}d)""")
    hr = f"{p}host_raw"
    pv = f"TRY_CAST({p}port AS INTEGER)"
    ok = f"({p}port = '' OR (regexp_matches({p}port, '^[0-9]+$') AND {pv} IS NOT NULL AND {pv} <= 65535))"
    c.append(f"""{p}f AS (SELECT * EXCLUDE ({p}host_raw),
 CASE WHEN contains({hr}, '%') THEN lower(regexp_extract({hr}, '(?s)^([^%]*)', 1)) || '%' || regexp_extract({hr}, '(?s)^[^%]*%(.*)$', 1)
      ELSE lower({hr}) END AS {p}host,
 NOT {ok} AS {p}port_error,
 CASE WHEN {ok} AND {p}port <> '' THEN {pv} END AS {p}port_num
 FROM {p}e)""")
    return c, f"{p}f"


def feature_ctes(src: str, id_cols: list[str], extras: bool = True) -> tuple[list[str], str]:
    """CTEs computing the 29 (+3) features of ``src.url``; final CTE name returned."""
    ctes, last = parts_ctes(src, "u_", True)
    h, path, q = "u_host", "u_path", "u_query"
    base = f"split_part({h}, '.', 1)"
    ctes.append(f"""fa AS (SELECT *, {base} AS f_base, {path} || {q} AS f_pq FROM {last})""")
    stem = "split_part(f_base, '-', 1)"
    stem_ok = f"(contains(f_base, '-') AND {stem} <> '')"
    # DuckDB's levenshtein counts bytes: one ASCII character stands for any other one
    one = lambda x: f"regexp_replace({x}, '[^\\x00-\\x7F]', '~', 'g')"
    ctes.append(f"fl AS (SELECT *, {one('f_base')} AS f_lbase, {one(stem)} AS f_lstem FROM fa)")
    bmin = "least(" + ", ".join(f"levenshtein(f_lbase, {_q(b)})" for b in BRAND_NAMES) + ")"
    smin = "least(" + ", ".join(f"levenshtein(f_lstem, {_q(b)})" for b in BRAND_NAMES) + ")"
    ctes.append(f"""fb AS (SELECT *, {bmin} AS f_bmin, CASE WHEN {stem_ok} THEN {smin} END AS f_smin FROM fl)""")
    min_lev = "(CASE WHEN f_base = '' THEN 99 ELSE least(f_bmin, f_smin) END)"
    sub = f"regexp_extract({h}, '(?s)^(.*)\\.[^.]*\\.[^.]*$', 1)"
    last_seg = f"regexp_extract({path}, '(?s)([^/]+)/*$', 1)"
    hl = f"length({h})"
    f = {
        "url_length": "length(url)",
        "num_dots": _cnt("url", "."),
        "num_hyphens": _cnt("url", "-"),
        "num_underscores": _cnt("url", "_"),
        "num_slashes": f"(CASE WHEN {path} = '' THEN 1 ELSE {_cnt(path, '/')} END)",
        "num_at": _cnt("url", "@"),
        "num_question": _cnt("url", "?"),
        "num_equals": _cnt("url", "="),
        "num_percent": _cnt("url", "%"),
        "num_digits_in_domain": _digits(h),
        "num_digits_in_path": _digits("f_pq"),
        "last_path_segment_is_integer": f"CAST(regexp_matches({last_seg}, '^{DIGIT_CLASS}+$') AS INTEGER)",
        "has_ip": f"CAST(regexp_matches({h}, '{_IPV4}') OR contains({h}, ':') AS INTEGER)",
        "has_https": "CAST(u_scheme = 'https' AS INTEGER)",
        "num_subdomains": f"greatest({_cnt(h, '.')} - 1, 0)",
        "hostname_length": hl,
        "path_length": f"length({path})",
        "double_slash": f"CAST(contains({path}, '//') AS INTEGER)",
        "num_suspicious_words": "(" + " + ".join(f"CAST(contains(lower(f_pq), {_q(w)}) AS INTEGER)" for w in SUSPICIOUS_WORDS) + ")",
        "has_at_in_url": "CAST(contains(url, '@') AS INTEGER)",
        "min_levenshtein": min_lev,
        "is_typosquat": f"CAST(({min_lev} BETWEEN 1 AND 2) OR ({stem_ok} AND coalesce(f_smin, 99) <= 2) AS INTEGER)",
        "hostname_entropy": _entropy(h),
        "digit_ratio_hostname": f"(CASE WHEN {hl} = 0 THEN 0.0E0 ELSE {round_even_sql(f'({_digits(h)} / {hl})')} END)",
        "query_length": f"length({q})",
        "num_params": f"(CASE WHEN {q} = '' THEN 0 ELSE {_cnt(q, '&')} + 1 END)",
        "has_port": "CAST(coalesce(u_port_num, 0) <> 0 AS INTEGER)",
        "tld_suspicious": f"CAST(lower(split_part({h}, '.', -1)) IN ({_list(SUSPICIOUS_TLDS)}) AS INTEGER)",
        "brand_in_subdomain": "CAST(" + " OR ".join(f"contains({sub}, {_q(b)})" for b in BRAND_NAMES) + " AS INTEGER)",
    }
    bad = "(u_bad_netloc OR url IS NULL)"
    sel = []
    for name in BASE_FEATURE_COLS:
        typ = "DOUBLE" if name in DOUBLE_FEATURES else "INTEGER"
        zero = "0.0E0" if name in DOUBLE_FEATURES else "0"
        sel.append(f"CAST(CASE WHEN {bad} THEN {zero} ELSE {f[name]} END AS {typ}) AS {name}")
    sel.append(f"({bad} OR coalesce(u_port_error, false)) AS parse_error")
    idc = ", ".join(id_cols)
    ctes.append(f"""feat AS (SELECT {idc}, {', '.join(sel)} FROM fb)""")
    if not extras:
        return ctes, "feat"
    # extras: parse again without the scheme prefix (same rows, no join back),
    # public-suffix sample (at most 2 labels deep)
    xc, xlast = parts_ctes("feat", "x_", False)
    ctes += xc
    rules = ", ".join(f"({_q(r)})" for r in PUBLIC_SUFFIX_SAMPLE)
    ctes.append(f"""psl AS (SELECT * FROM (VALUES {rules}) t(rule))""")
    ctes.append("""lk AS (SELECT CASE WHEN starts_with(rule, '!') THEN substr(rule, 2) WHEN starts_with(rule, '*.') THEN substr(rule, 3) ELSE rule END AS key,
 max(CAST(NOT starts_with(rule, '!') AND NOT starts_with(rule, '*.') AS INTEGER)) AS is_rule,
 max(CAST(starts_with(rule, '*.') AS INTEGER)) AS is_wild,
 max(CAST(starts_with(rule, '!') AS INTEGER)) AS is_exc FROM psl GROUP BY 1)""")
    ctes.append(f"""xh AS (SELECT *,
 CASE WHEN x_bad_netloc OR url IS NULL THEN '' ELSE regexp_replace(x_host, '\\.+$', '') END AS hh FROM {xlast})""")
    ctes.append("""xn AS (SELECT *, CASE WHEN hh = '' THEN 0 ELSE len(string_split(hh, '.')) END AS nl,
 CASE WHEN hh <> '' THEN split_part(hh, '.', -1) END AS c1,
 CASE WHEN hh <> '' AND len(string_split(hh, '.')) >= 2 THEN split_part(hh, '.', -2) || '.' || split_part(hh, '.', -1) END AS c2 FROM xh)""")
    ctes.append("""xs AS (SELECT xn.*,
 CASE WHEN coalesce(l2.is_exc, 0) = 1 THEN 1
      WHEN coalesce(l2.is_rule, 0) = 1 OR (nl >= 2 AND coalesce(w2.is_wild, 0) = 1) THEN 2
      WHEN coalesce(l1.is_exc, 0) = 1 THEN 0
      WHEN coalesce(l1.is_rule, 0) = 1 THEN 1 ELSE 0 END AS slen
 FROM xn LEFT JOIN lk l1 ON xn.c1 = l1.key LEFT JOIN lk l2 ON xn.c2 = l2.key
 LEFT JOIN lk w2 ON (CASE WHEN nl >= 2 THEN xn.c1 END) = w2.key)""")
    chain = "0"
    for b in reversed(BRAND_NAMES):
        chain = f"CASE WHEN contains(hh, {_q(b)}) THEN CAST(lower(dom) <> {_q(b)} AS INTEGER) ELSE {chain} END"
    ctes.append(f"""xd AS (SELECT *, CASE WHEN slen > 0 AND nl > slen THEN split_part(hh, '.', nl - slen) ELSE '' END AS dom FROM xs)""")
    fcols = ", ".join(id_cols + BASE_FEATURE_COLS + ["parse_error"])
    ctes.append(f"""xf AS (SELECT {fcols},
 CAST(CASE WHEN url IS NULL THEN 0.0E0 ELSE {_entropy('url')} END AS DOUBLE) AS url_entropy,
 CAST(CASE WHEN hh = '' OR regexp_matches(x_host, '{_IPV4}') OR slen = 0 THEN 0 ELSE {chain} END AS INTEGER) AS brand_impersonation,
 CAST(CASE WHEN x_bad_netloc OR url IS NULL THEN 0 ELSE len(regexp_extract_all(x_path, '[^/]+')) END AS INTEGER) AS path_depth
 FROM xd)""")
    return ctes, "xf"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
