"""Lexical URL features as native column expressions.

``with_url_features`` appends the 29 base features (27 INT, 2 DOUBLE) and a
``parse_error`` flag; ``with_extra_features`` appends ``url_entropy``,
``brand_impersonation`` and ``path_depth``. Both are narrow projections (no
shuffle, no Python): they run in batch and in Structured Streaming alike.

Edit distances use the built-in ``levenshtein`` (JVM, code points) under
an ``aggregate`` over the 32 brands, for the first host label and its hyphen stem. Entropy
is a per-row ``aggregate`` over the distinct characters, so no explode/group-by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk.constants import (
    DIGIT_CLASS, ALL_FEATURE_COLS, BASE_FEATURE_COLS, BRAND_NAMES, DOUBLE_FEATURES,
    EXTRA_FEATURE_COLS, FEATURE_EXPLANATIONS, FLAG_RULES, NO_HOST_DISTANCE,
    SUSPICIOUS_TLDS, SUSPICIOUS_WORDS,
    REPORT_GOOD_FEATURES, REPORT_RISK_RULES,
)
from linkrisk.functions.suffix import with_registered_domain
from linkrisk.functions.urlparts import part_names, stage, with_url_parts

_DIGIT = DIGIT_CLASS  # what str.isdigit accepts
_IPV4 = r"^\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}$"


def round_even(c: Column, digits: int = 4) -> Column:
    """Round half-even on the exact binary value, like Python's ``round(x, n)``.

    ``p = x * 10^n`` is itself rounded, so a value just above a tie (0.98765 is
    0.987650000000000028 in binary) can land just below it. Dekker's exact
    product recovers the error ``e`` of that multiplication with plain double
    arithmetic (split x into 26-bit halves); on an apparent tie the sign of
    ``e`` decides, and a true tie goes to the even neighbour.
    """
    s = float(10 ** digits)
    a = F.abs(c)
    p = a * F.lit(s)
    big = F.lit(134217729.0) * a  # 2^27 + 1
    a_hi = big - (big - a)
    a_lo = a - a_hi
    e = (a_hi * F.lit(s) - p) + a_lo * F.lit(s)
    # on a tie the sign of e decides, else rint goes to the even neighbour; each name is
    # written out wherever it is used, so the expression is kept short
    k = F.rint(p + F.when(p - F.floor(p) == 0.5, F.signum(e) * F.lit(0.25)).otherwise(F.lit(0.0)))
    return F.signum(c) * k / F.lit(s)


def count_char(c: Column, ch: str) -> Column:
    """Occurrences of a single character."""
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def count_digits(c: Column) -> Column:
    """Characters ``str.isdigit`` accepts; ASCII text (bytes = chars) takes the
    cheap ``[0-9]`` path, other text the full Unicode digit class."""
    ascii_only = F.octet_length(c) == F.length(c)
    return F.when(ascii_only, F.length(c) - F.length(F.regexp_replace(c, "[0-9]", ""))).otherwise(
        F.length(c) - F.length(F.regexp_replace(c, _DIGIT, "")))


def shannon_entropy(c: Column) -> Column:
    """Shannon entropy (bits) of the characters of ``c``; '' -> 0.0.

    ``H = log2(n) - sum(f * log2 f) / n`` over the character frequencies f,
    taken as the runs of the sorted characters (one regex pass, no per-char
    rescans of the text).
    """
    n = F.length(c)
    # sort_array and split run natively; array_sort calls an interpreted comparator
    chars = F.sort_array(F.split(c, ""))
    runs = F.regexp_extract_all(F.array_join(chars, ""), F.lit("(?s)((.)\\2*)"), 1)
    s = F.aggregate(runs, F.lit(0.0).cast("double"),
                    lambda acc, r: acc + F.length(r) * F.log2(F.length(r)))
    h = F.log2(n) - s / n
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.greatest(h, F.lit(0.0)))


def _texts(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def _least_lev(label: Column) -> Column:
    """Least edit distance to a brand. A distance is never below the difference in length,
    so brands that cannot come nearer are passed over."""
    return F.aggregate(_texts(BRAND_NAMES), F.lit(2**31 - 1), lambda least, b: F.when(
        F.abs(F.length(label) - F.length(b)) >= least, least).otherwise(F.least(least, F.levenshtein(label, b))))


def _b(c: Column) -> Column:
    return c.cast("int")


def with_url_features(df: DataFrame, url_col: str = "url", keep_parts: bool = False) -> DataFrame:
    """Append the 29 base features and ``parse_error``."""
    df = with_url_parts(df, url_col, add_scheme=True, prefix="u_")
    url = F.col(url_col)
    host, path, query = F.col("u_host"), F.col("u_path"), F.col("u_query")
    bad = F.col("u_bad_netloc") | url.isNull()

    # The generated code of a projection should stay below 8,000 bytes a method, as the JVM
    # only interprets longer ones: loops over word lists are array functions, and what the
    # last projection names more than once is worked out before it.
    # stage A: first host label and its hyphen stem
    df = stage(df, [F.substring_index(host, ".", 1).alias("f_base")])
    base = F.col("f_base")
    df = stage(df, [F.substring_index(base, "-", 1).alias("f_stem"), F.concat(path, query).alias("f_pq")])
    stem, pq = F.col("f_stem"), F.col("f_pq")
    stem_ok = base.contains("-") & (stem != "")
    # stage B: edit distances, counts and texts
    df = stage(df, [
        F.lower(pq).alias("f_pql"),
        count_digits(host).alias("f_hdig"),
        F.regexp_extract(host, r"(?s)^(.*)\.[^.]*\.[^.]*$", 1).alias("f_sub"),
        _least_lev(base).alias("f_base_min"),
        F.when(stem_ok, _least_lev(stem)).alias("f_stem_min"),
        # a higher-order function is never shared by subexpression elimination:
        # materialise it once here, round the column reference later
        shannon_entropy(host).alias("f_hent"),
    ])
    base_min, stem_min = F.col("f_base_min"), F.col("f_stem_min")
    min_lev = F.when(base == "", F.lit(NO_HOST_DISTANCE)).otherwise(F.least(base_min, stem_min))
    host_len = F.length(host)
    last_seg = F.regexp_extract(path, r"(?s)([^/]+)/*$", 1)

    feats: dict[str, Column] = {
        "url_length": F.length(url),
        "num_dots": count_char(url, "."),
        "num_hyphens": count_char(url, "-"),
        "num_underscores": count_char(url, "_"),
        "num_slashes": F.when(path == "", F.lit(1)).otherwise(count_char(path, "/")),
        "num_at": count_char(url, "@"),
        "num_question": count_char(url, "?"),
        "num_equals": count_char(url, "="),
        "num_percent": count_char(url, "%"),
        "num_digits_in_domain": F.col("f_hdig"),
        "num_digits_in_path": count_digits(F.col("f_pq")),
        "last_path_segment_is_integer": _b(last_seg.rlike("^" + DIGIT_CLASS + "+$")),
        "has_ip": _b(host.rlike(_IPV4) | host.contains(":")),
        "has_https": _b(F.col("u_scheme") == "https"),
        "num_subdomains": F.greatest(count_char(host, ".") - 1, F.lit(0)),
        "hostname_length": host_len,
        "path_length": F.length(path),
        "double_slash": _b(path.contains("//")),
        "num_suspicious_words": F.size(F.filter(_texts(SUSPICIOUS_WORDS), lambda w: F.contains(F.col("f_pql"), w))),
        "has_at_in_url": _b(url.contains("@")),
        "min_levenshtein": min_lev,
        "is_typosquat": _b(min_lev.between(1, 2) | (stem_ok & (F.coalesce(stem_min, F.lit(99)) <= 2))),
        "hostname_entropy": round_even(F.col("f_hent"), 4),
        "digit_ratio_hostname": F.when(host_len == 0, F.lit(0.0))
        .otherwise(F.get(F.transform(F.array(F.col("f_hdig") / host_len), lambda v: round_even(v, 4)), F.lit(0))),
        "query_length": F.length(query),
        "num_params": F.when(query == "", F.lit(0)).otherwise(count_char(query, "&") + 1),
        "has_port": _b(F.coalesce(F.col("u_port_num"), F.lit(0)) != 0),
        "tld_suspicious": _b(F.lower(F.substring_index(host, ".", -1)).isin(SUSPICIOUS_TLDS)),
        "brand_in_subdomain": _b(F.exists(_texts(BRAND_NAMES), lambda b: F.contains(F.col("f_sub"), b))),
    }
    out = []
    for name in BASE_FEATURE_COLS:
        zero = F.lit(0.0) if name in DOUBLE_FEATURES else F.lit(0)
        typ = "double" if name in DOUBLE_FEATURES else "int"
        out.append(F.when(bad, zero).otherwise(feats[name]).cast(typ).alias(name))
    out.append((bad | F.col("u_port_error")).alias("parse_error"))
    drop = ("f_base", "f_stem", "f_pq", "f_pql", "f_hdig", "f_sub", "f_base_min", "f_stem_min", "f_hent") + (() if keep_parts else part_names("u_"))
    return stage(df, out, drop)


def with_extra_features(df: DataFrame, url_col: str = "url", suffix_rules: DataFrame | None = None) -> DataFrame:
    """Append H22-H24: ``url_entropy``, ``brand_impersonation``, ``path_depth``.

    These parse the URL *without* the ``http://`` prefix (scheme-less text has
    no host). ``suffix_rules`` is a one-column table ``rule`` in public-suffix
    list syntax; the bundled sample is used when omitted.
    """
    url = F.col(url_col)
    df = with_url_parts(df, url_col, add_scheme=False, prefix="x_")
    host = F.regexp_replace(F.col("x_host"), r"\.+$", "")
    bad = F.col("x_bad_netloc") | url.isNull()
    df = stage(df, [F.when(bad, F.lit("")).otherwise(host).alias("x_h"),
                    shannon_entropy(url).alias("x_ent")])
    df = with_registered_domain(df, "x_h", suffix_rules, prefix="x_")
    h = F.col("x_h")
    reg = F.lower(F.col("x_domain"))
    # the first brand (list order) contained in the host decides
    chain = F.expr("CASE " + " ".join(f"WHEN contains(x_h, '{b}') THEN CAST(lower(x_domain) <> '{b}' AS INT)"
                                      for b in BRAND_NAMES) + " ELSE 0 END")
    impersonation = F.when(
        (h == "") | F.col("x_host").rlike(_IPV4) | (F.col("x_suffix_len") == 0), F.lit(0)
    ).otherwise(chain)
    depth = F.when(bad, F.lit(0)).otherwise(F.regexp_count(F.col("x_path"), F.lit("[^/]+")))
    return stage(df, [
        F.when(url.isNull(), F.lit(0.0)).otherwise(round_even(F.col("x_ent"), 4)).alias("url_entropy"),
        impersonation.cast("int").alias("brand_impersonation"),
        depth.cast("int").alias("path_depth"),
    ], part_names("x_") + ("x_h", "x_ent", "x_domain", "x_suffix_len"))


def with_all_features(df: DataFrame, url_col: str = "url", suffix_rules: DataFrame | None = None) -> DataFrame:
    return with_extra_features(with_url_features(df, url_col), url_col, suffix_rules)


def feature_report(df: DataFrame, id_cols: list[str], suffix_rules: DataFrame | None = None) -> DataFrame:
    """One row per (url, feature): value, explanation, is_extra.

    ``stack`` unpivots in the same projection: no join, no shuffle.
    """
    f = with_all_features(df.select(*id_cols), "url", suffix_rules)
    args = []
    for name in ALL_FEATURE_COLS:
        expl = FEATURE_EXPLANATIONS[name].replace("'", "\\'")
        args.append(f"'{name}', CAST({name} AS DOUBLE), '{expl}', {'true' if name in EXTRA_FEATURE_COLS else 'false'}")
    stack = f"stack({len(ALL_FEATURE_COLS)}, {', '.join(args)}) AS (feature, value, explanation, is_extra)"
    return f.selectExpr(*id_cols, stack)


def report_flags(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """H28, report variant: every base feature with its state: risk, good or neutral."""
    f = with_url_features(df.select(*id_cols), "url")
    risk = {name: f"{name} {op} {v}" for name, op, v in REPORT_RISK_RULES}
    good = {name: f"{name} != 0" for name in REPORT_GOOD_FEATURES}
    args = [f"'{c}', CAST({c} AS DOUBLE), CASE WHEN {risk.get(c, 'false')} THEN 'risk' WHEN {good.get(c, 'false')} THEN 'good' "
            "ELSE 'neutral' END" for c in BASE_FEATURE_COLS]
    return f.selectExpr(*id_cols, f"stack({len(args)}, {', '.join(args)}) AS (feature, value, state)")


def flagged_features(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """The 12-feature panel with its per-feature risk flag."""
    f = with_url_features(df.select(*id_cols), "url")
    args = []
    for name, op, v in FLAG_RULES:
        args.append(f"'{name}', {name}, CAST({name} {op} {v} AS INT)")
    stack = f"stack({len(FLAG_RULES)}, {', '.join(args)}) AS (feature, value, flagged)"
    return f.selectExpr(*id_cols, stack)
