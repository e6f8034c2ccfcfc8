"""H0: split URLs into scheme / netloc / host / port / path / query / fragment.

Pure column expressions (regexp_extract & co.), evaluated per row inside
whole-stage codegen: no UDF, no shuffle. The rules reproduce the Python stdlib
splitter that the original feature code calls, because ``parse_url`` differs
from it (NULL on underscores and spaces, keeps host case, no port part).

Rules:
* optional ``http://`` prefix when the text has no ``://`` anywhere;
* leading C0 controls and spaces stripped, ``\\t \\r \\n`` deleted everywhere;
* scheme = ``^[A-Za-z][A-Za-z0-9+.-]*:`` lowercased; netloc only after ``//``
  and up to the first of ``/?#``;
* fragment after the first ``#``, query after the first ``?``;
* ``;params`` cut from the last path segment for the schemes that use them;
* host: after the last ``@``, brackets removed, lowercased (IPv6 zone kept);
  port after ``:``;
* an unbalanced bracket in the netloc, or bracket content that is not an IPv6
  / IPvFuture address, is a parse error (as in the Python 3.13 stdlib).

The stages are separate projections so each regular expression runs once per
row; Catalyst does not collapse a projection when that would duplicate a
non-trivial expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk.constants import SCHEMES_WITH_PARAMS

_SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def bracket_host_regex() -> str:
    """Valid content of a bracketed host: an IPv6 address (optional zone
    ``%id``) or an IPvFuture literal. Generated from the address grammar:
    8 hextets, or 6 hextets + dotted IPv4 (octets 0-255, no leading zeros),
    with at most one ``::`` standing for one or more zero hextets."""
    h = "[0-9A-Fa-f]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = octet + r"(?:\." + octet + "){3}"

    def seq(n: int) -> str:
        return "" if n == 0 else h + ("(?::" + h + "){" + str(n - 1) + "}" if n > 1 else "")

    alts = [seq(8), seq(6) + ":" + v4]
    for total, tail in ((8, ""), (6, v4)):
        for k in range(total):
            for m in range(total - k):
                right = seq(m) + (":" + tail if tail and m else tail)
                alts.append(seq(k) + "::" + right)
    v6 = "(?:" + "|".join(alts) + ")(?:%[^%]+)?"
    return r"^(?:v[0-9A-Fa-f]+\..+|" + v6 + r")\z"


_V6_RE = bracket_host_regex()


def _after_first(c: Column, sep: str) -> Column:
    """Text after the first ``sep`` ('' when absent, NULL for NULL)."""
    i = F.instr(c, sep)
    return F.when(i > 0, c.substr(i + 1, F.length(c))).when(c.isNotNull(), F.lit(""))


def _before_first(c: Column, sep: str) -> Column:
    """Text before the first ``sep`` (all of it when absent)."""
    return F.substring_index(c, sep, 1)


def stage(df: DataFrame, new: list[Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """One projection: keep the columns not in ``drop`` and append ``new``
    (a single plan step, so the client analyses the plan once per stage)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in drop], *new)


def with_url_parts(df: DataFrame, url_col: str = "url", add_scheme: bool = True,
                   prefix: str = "u_") -> DataFrame:
    """Append ``{prefix}scheme, netloc, host, port, path, query, fragment,
    bad_netloc, port_error`` to ``df``."""
    p = prefix
    u = F.col(url_col)
    s = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("http://"), u)) if add_scheme else u
    s = F.ltrim(s, F.lit("".join(map(chr, range(0x21)))))

    # stage 1: scheme and the rest; the usual cases need no regular expression
    df = df.select("*", s.alias(p + "s0"))
    s0 = F.col(p + "s0")
    breaks = s0.contains("\t") | s0.contains("\r") | s0.contains("\n")
    df = stage(df, [F.when(breaks, F.regexp_replace(s0, r"[\t\r\n]", "")).otherwise(s0).alias(p + "s")], (p + "s0",))
    s = F.col(p + "s")
    df = stage(df, [F.when(s.startswith("http://"), F.lit("http")).when(s.startswith("https://"), F.lit("https"))
                    .when(s.rlike(_SCHEME_RE), F.regexp_extract(s, "(" + _SCHEME_RE[:-1] + "):", 1))
                    .otherwise(F.lit("")).alias(p + "scheme0")])
    scheme = F.col(p + "scheme0")
    df = stage(df, [
        F.lower(scheme).alias(p + "scheme"),
        F.when(scheme != "", s.substr(F.length(scheme) + 2, F.length(s))).otherwise(s).alias(p + "rest"),
    ], (p + "s", p + "scheme0"))

    # stage 2: netloc and the remainder (path ? query # fragment)
    rest = F.col(p + "rest")
    has_net = rest.startswith("//")
    until = rest.substr(F.lit(3), F.length(rest))
    for sep in "/?#":
        until = _before_first(until, sep)
    df = stage(df, [F.when(has_net, until).otherwise(F.lit("")).alias(p + "netloc")])
    df = stage(df, [F.when(has_net, rest.substr(F.length(F.col(p + "netloc")) + 3, F.length(rest))).otherwise(rest).alias(p + "tail")],
               (p + "rest",))

    # stage 3: fragment, query, raw path, host info
    tail = F.col(p + "tail")
    net = F.col(p + "netloc")
    before_frag = _before_first(tail, "#")
    df = stage(df, [
        _after_first(tail, "#").alias(p + "fragment"),
        _before_first(before_frag, "?").alias(p + "path0"),
        _after_first(before_frag, "?").alias(p + "query"),
        F.substring_index(net, "@", -1).alias(p + "hostinfo"),
    ], (p + "tail",))

    # stage 4: host, port, path without params, parse errors
    hi = F.col(p + "hostinfo")
    path0 = F.col(p + "path0")
    bracketed = _after_first(hi, "[")
    b_host = _before_first(bracketed, "]")
    b_after = _after_first(bracketed, "]")
    has_open = hi.contains("[")
    host_raw = F.when(has_open, b_host).otherwise(_before_first(hi, ":"))
    port_raw = F.when(has_open, _after_first(b_after, ":")).otherwise(_after_first(hi, ":"))
    unbalanced = net.contains("[") != net.contains("]")
    # the text between the netloc's first '[' and the next ']' must be an
    # IPv6 address or an IPvFuture literal
    net_bracketed = _before_first(_after_first(net, "["), "]")
    bad_bracket = net.contains("[") & net.contains("]") & ~net_bracketed.rlike(_V6_RE)
    path = F.when(
        F.col(p + "scheme").isin(SCHEMES_WITH_PARAMS) & path0.contains(";"),
        F.regexp_replace(path0, r"(?s);[^/]*$", ""),
    ).otherwise(path0)
    df = stage(df, [
        path.alias(p + "path"),
        host_raw.alias(p + "host_raw"),
        port_raw.alias(p + "port"),
        (unbalanced | bad_bracket).alias(p + "bad_netloc"),
    ], (p + "path0", p + "hostinfo"))

    # stage 5: lowercase host (an IPv6 zone after '%' keeps its case), port check
    hr = F.col(p + "host_raw")
    host = F.when(
        hr.contains("%"),
        F.concat(F.lower(_before_first(hr, "%")), F.lit("%"), _after_first(hr, "%")),
    ).otherwise(F.lower(hr))
    port = F.col(p + "port")
    df = stage(df, [host.alias(p + "host"), F.when(port.rlike("^[0-9]+$"), port.try_cast("int")).alias(p + "port_val")],
               (p + "host_raw",))
    fits = F.col(p + "port_val") <= 65535
    df = stage(df, [
        ((port != "") & ~F.coalesce(fits, F.lit(False))).alias(p + "port_error"),
        F.when(fits, F.col(p + "port_val")).alias(p + "port_num"),
    ], (p + "port_val",))
    return df


PART_COLUMNS = ["scheme", "netloc", "host", "port", "path", "query", "fragment",
                "bad_netloc", "port_error", "port_num"]


def part_names(prefix: str) -> tuple[str, ...]:
    return tuple(prefix + c for c in PART_COLUMNS)
