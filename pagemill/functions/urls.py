"""URL functions as native column expressions. Non-ASCII hosts alone need Python (IDNA), on a filtered branch."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups: scheme, authority, path, query, fragment. No lookaround, so DuckDB reads it too.
SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCOPES = ("domain-only", "host-only", "subdomain")
LAYOUTS = ("default", "flatten_domain", "hierarchical", "flatten_all")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it in many places: expressions that repeat it outgrow what the JVM compiles."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _clean(url: Column) -> Column:
    """As urlsplit reads it: no leading control characters or blanks, no tabs or line ends."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def split_url(url: Column) -> Column:
    """Struct of scheme, netloc, path, query, fragment, userinfo (null: none), host (lower case, no brackets), port (text; null: none)."""

    def named(p: Column) -> Column:
        address = F.regexp_replace(p["netloc"], r"^.*@", "")
        bracket = address.startswith("[")
        host = F.when(bracket, F.regexp_extract(address, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(address, ":", 1))
        rest = F.when(bracket, F.regexp_extract(address, r"^\[[^\]]*\](.*)$", 1)).otherwise(F.regexp_replace(address, r"^[^:]*", ""))
        return F.struct(
            F.lower(p["scheme"]).alias("scheme"),
            *[p[c].alias(c) for c in ("netloc", "path", "query", "fragment")],
            F.when(F.contains(p["netloc"], F.lit("@")), F.regexp_extract(p["netloc"], r"^(.*)@", 1)).alias("userinfo"),
            F.lower(host).alias("host"),
            F.nullif(F.regexp_replace(rest, "^:", ""), F.lit("")).alias("port"),
        )

    # each group is taken once; what is made of the parts is looked at once more, not matched again
    groups = lambda u: F.struct(*[F.regexp_extract(u, SPLIT, k + 1).alias(c) for k, c in enumerate(("scheme", "netloc", "path", "query", "fragment"))])
    return let(_clean(url), lambda u: let(groups(u), named))


#: Fixed values of Python's urllib.parse: schemes whose references resolve, and those of them with parameters after a semicolon.
RELATIVE = ("", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss")
PARAMETERS = ("", "ftp", "http", "prospero", "imap", "https", "shttp", "rtsp", "rtsps", "mms", "sftp")


def _address_6() -> str:
    """A pattern of IPv6 addresses, of all places that the run of zeros can have, with an IPv4 end and a zone."""
    four = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    end = f"(?:H:H|{four})"
    ways = [f"(?:H:){{6}}{end}", *(f"(?:(?:H:){{0,{k - 1}}}H)?::(?:H:){{{5 - k}}}{end}" if k else f"::(?:H:){{5}}{end}" for k in range(6)), "(?:(?:H:){0,5}H)?::H", "(?:(?:H:){0,6}H)?::"]
    return "(?:" + "|".join(ways).replace("H", "[0-9A-Fa-f]{1,4}") + ")(?:%[^%]+)?"


@lru_cache(1)
def _unsound_letters() -> str:
    """Letters whose compatible form has a delimiter of addresses: no authority may have them."""
    return "".join(c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and set("/?#@:") & set(unicodedata.normalize("NFKC", c)))


def _sound_authority(netloc: Column) -> Column:
    """Whether brackets pair and hold an IPv6 (or future) address, and no letter hides a delimiter."""
    inside = F.regexp_extract(netloc, r"(?s)^[^\[]*\[([^\]]*)", 1)
    bare = ~netloc.rlike(r"[\[\]]")
    held = netloc.rlike(r"\[") & netloc.rlike(r"\]") & inside.rlike(f"^(?:{_address_6()}|v[0-9A-Fa-f]+\\..+)$")
    return (bare | held) & ~netloc.rlike(f"[{_unsound_letters()}]")


def url_join(base: Column, reference: Column) -> Column:
    """The reference resolved against the base, as urllib.parse.urljoin has it; null where either is null or has a malformed authority.

    Segments are merged and dots removed by a fold over an array, so it is all native.
    """

    def params(path: Column, scheme: Column) -> Column:
        """Struct of a path and what follows the first semicolon of its last segment."""
        at = r"(?s)^((?:.*/)?[^/;]*)(;[^/]*)?$"
        some = scheme.isin(*PARAMETERS)
        return F.struct(
            F.when(some, F.regexp_extract(path, at, 1)).otherwise(path).alias("path"),
            F.when(some, F.regexp_replace(F.regexp_extract(path, at, 2), "^;", "")).otherwise("").alias("params"),
        )

    def whole(scheme: Column, netloc: Column, path: Column, params: Column, query: Column, fragment: Column) -> Column:
        mark = lambda sign, c: F.when(c != "", F.concat(F.lit(sign), c)).otherwise("")
        path = F.concat(path, mark(";", params))
        rooted = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
        bare = path.startswith("//") | (scheme != "") & ((path == "") | path.startswith("/"))
        place = F.when(netloc != "", F.concat(F.lit("//"), netloc, rooted)).when(bare, F.concat(F.lit("//"), path)).otherwise(path)
        return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), place, mark("?", query), mark("#", fragment))

    def merged(base_path: Column, path: Column) -> Column:
        own = F.split(path, "/")
        folder = F.split(base_path, "/")
        folder = F.when(F.element_at(folder, -1) != "", F.slice(folder, F.lit(1), F.size(folder) - 1)).otherwise(folder)
        all_ = F.concat(folder, own)
        inner = F.filter(F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 2, F.lit(0))), lambda x: x != "")
        ends = lambda a: F.when(F.size(a) > 1, F.concat(F.slice(a, 1, 1), inner, F.slice(a, -1, 1))).otherwise(a)
        segments = F.when(path.startswith("/"), own).otherwise(ends(all_))
        up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
        step = lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x)))

        def folded(s: Column) -> Column:
            out = F.aggregate(s, F.array().cast("array<string>"), step)
            out = F.when(F.element_at(s, -1).isin(".", ".."), F.concat(out, F.array(F.lit("")))).otherwise(out)
            return F.coalesce(F.nullif(F.array_join(out, "/"), F.lit("")), F.lit("/"))

        return let(segments, folded)

    def resolved(x: Column) -> Column:
        b, r = x["b"], x["r"]
        scheme = F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"])
        away = (scheme != b["scheme"]) | ~scheme.isin(*RELATIVE)

        def joined(p: Column) -> Column:
            bp, rp = p["b"], p["r"]
            query = F.when(r["query"] != "", r["query"]).otherwise(b["query"])
            return (
                F.when(r["netloc"] != "", whole(scheme, r["netloc"], rp["path"], rp["params"], r["query"], r["fragment"]))
                .when((rp["path"] == "") & (rp["params"] == ""), whole(scheme, b["netloc"], bp["path"], bp["params"], query, r["fragment"]))
                .otherwise(whole(scheme, b["netloc"], merged(bp["path"], rp["path"]), rp["params"], r["query"], r["fragment"]))
            )

        sound = _sound_authority(b["netloc"]) & _sound_authority(r["netloc"])
        inner = let(F.struct(params(b["path"], b["scheme"]).alias("b"), params(r["path"], scheme).alias("r")), joined)
        return F.when(sound, F.when(away, x["reference"]).otherwise(inner))

    parts = lambda u: let(_clean(u), lambda c: F.struct(*[(F.lower if name == "scheme" else lambda v: v)(F.regexp_extract(c, SPLIT, k + 1)).alias(name) for k, name in enumerate(("scheme", "netloc", "path", "query", "fragment"))]))

    def told(x: Column) -> Column:
        b, r = x["b"], x["r"]
        both = let(F.struct(parts(b).alias("b"), parts(r).alias("r"), r.alias("reference")), resolved)
        return F.when(b == "", r).when(r == "", b).when(b.isNotNull() & r.isNotNull(), both)

    return let(F.struct(base.alias("b"), reference.alias("r")), told)


def valid_port(port: Column) -> Column:
    """Null ports are valid: the scheme's default holds."""
    number = F.when(port.rlike(r"^[0-9]{1,9}$"), port.try_cast("int"))
    return port.isNull() | F.coalesce(number <= 65535, F.lit(False))


def is_http(scheme: Column) -> Column:
    return scheme.isin("http", "https")


def _ascii_labels(host: Column) -> Column:
    """Whether every label has 1 to 63 characters (a trailing dot is none)."""
    return host.rlike(r"^[^.]{1,63}(\.[^.]{1,63})*\.?$")


def _identity_of(s: Column, host: Column) -> Column:
    default = F.when(s["scheme"] == "https", 443).otherwise(80)
    number = s["port"].try_cast("int")
    net = F.when(number.isNull() | (number == default), host).otherwise(F.concat(host, F.lit(":"), number.cast("string")))
    query = F.when(s["query"] != "", F.concat(F.lit("?"), s["query"])).otherwise("")
    good = is_http(s["scheme"]) & s["userinfo"].isNull() & (s["host"] != "") & valid_port(s["port"])
    return F.when(good & host.isNotNull(), F.concat(s["scheme"], F.lit("://"), net, F.when(s["path"] == "", "/").otherwise(s["path"]), query))


def identity(url: Column) -> Column:
    """The fragment-free identity of an HTTP(S) url with an ASCII host; null for anything invalid and for other hosts, which
    any_identity() takes."""
    return let(split_url(url), lambda s: _identity_of(s, _ascii_host(s["host"])))


def _ascii_host(host: Column) -> Column:
    return F.when(host.rlike(r"^[\x00-\x7F]+$") & _ascii_labels(host), F.regexp_replace(host, r"\.+$", ""))


def any_identity(url: Column) -> Column:
    """The identity of a url with a host in any script, in one pass: only non-ASCII hosts travel to Python, as what is null elsewhere."""
    from pagemill.functions.pages import idna_host

    host = split_url(url)["host"]
    wide = idna_host(F.when(host.rlike(r"[^\x00-\x7F]"), host))
    return let(F.struct(split_url(url).alias("s"), wide.alias("w")), lambda x: _identity_of(x["s"], F.coalesce(_ascii_host(x["s"]["host"]), x["w"])))


def with_identity(df: DataFrame, url: str = "url", name: str = "identity") -> DataFrame:
    """Adds the identity column, of hosts in any script."""
    return df.withColumn(name, any_identity(F.col(url)))


def is_remote(url: Column) -> Column:
    return F.coalesce(is_http(split_url(url)["scheme"]), F.lit(False))


def is_url(source: Column, force_local: bool = False) -> Column:
    return F.lit(False) if force_local else F.coalesce(source.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def effective_port(s: Column) -> Column:
    number = F.nullif(s["port"].try_cast("int"), F.lit(0))
    return F.coalesce(number, F.when(s["scheme"] == "https", 443).otherwise(80))


def compile_scope(rule: str) -> str:
    """A built-in scope's name, or a regular expression that compiles."""
    if rule not in SCOPES:
        re.compile(rule)
    return rule


def in_scope(url: Column, base: Column, rule: str) -> Column:
    """Whether a crawl follows a link. Other rules than the built-in ones are Java regular expressions, searched in the whole url."""
    rule = compile_scope(rule)

    def judged(p: Column) -> Column:
        a, b = p["a"], p["b"]
        ah, bh = F.regexp_replace(a["host"], r"\.+$", ""), F.regexp_replace(b["host"], r"\.+$", "")
        sound = is_http(a["scheme"]) & is_http(b["scheme"]) & (a["host"] != "") & (b["host"] != "") & a["userinfo"].isNull() & valid_port(a["port"]) & valid_port(b["port"])
        tests = {
            "domain-only": lambda: (ah == bh) & (effective_port(a) == effective_port(b)),
            "host-only": lambda: ah == bh,
            "subdomain": lambda: (ah == bh) | ah.endswith(F.concat(F.lit("."), bh)),
        }
        return sound & (tests[rule]() if rule in tests else url.rlike(rule))

    return F.coalesce(let(F.struct(split_url(url).alias("a"), split_url(base).alias("b")), judged), F.lit(False))


def origin_key(url: Column) -> Column:
    """The scheduler's key: scheme and authority in lower case, as they stand."""
    s = split_url(url)
    return F.concat(s["scheme"], F.lit("://"), F.lower(s["netloc"]))


def limiter_key(url: Column) -> Column:
    return F.lower(split_url(url)["netloc"])


def robots_url(url: Column) -> Column:
    s = split_url(url)
    return F.concat(s["scheme"], F.lit("://"), s["netloc"], F.lit("/robots.txt"))


def destination_origin(url: Column) -> Column:
    """Struct of scheme, host and port that a guarded request may go to; null where the url is unsafe or malformed."""
    s = split_url(url)
    host = F.regexp_replace(s["host"], r"\.+$", "")
    name = (F.length(host) <= 253) & host.rlike(r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*$")
    address = F.contains(host, F.lit(":")) & host.rlike(r"^[0-9a-f:.]+$")
    good = is_http(s["scheme"]) & s["userinfo"].isNull() & valid_port(s["port"]) & (name | address)
    port = F.coalesce(s["port"].try_cast("int"), F.when(s["scheme"] == "https", 443).otherwise(80))
    return F.when(good, F.struct(s["scheme"].alias("scheme"), host.alias("host"), port.alias("port")))


def normalize_hostname(host: Column) -> Column:
    """A plain host in lower case without surrounding dots; other than ASCII goes through idna_host."""
    h = F.lower(F.regexp_replace(F.trim(host), r"^\.+|\.+$", ""))
    return F.when(h.rlike(r"^[\x00-\x7F]*$") & (_ascii_labels(h) | (h == "")), h).otherwise("")


def safe_segment(value: Column) -> Column:
    """One safe part of a path: percent-decoded once, other than letters, digits, `_`, `.` and `-` replaced. A stray percent sign
    stands for itself."""
    decoded = F.try_url_decode(F.regexp_replace(F.regexp_replace(value, r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25"))
    clean = F.regexp_replace(F.trim(decoded), r"[^\p{L}\p{N}_.-]", "_")
    clean = F.regexp_replace(clean, r"^[. ]+|[. ]+$", "")
    return F.when(clean == "", "_").otherwise(clean)


def output_path(identity_: Column, layout: str = "default") -> Column:
    """The archive's path for an identity: never outside its root, different for every identity."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout is one of {LAYOUTS}")

    def pieces(s: Column) -> Column:
        parts = F.transform(F.filter(F.split(s["path"], "/"), lambda p: p != ""), safe_segment)
        return F.struct(safe_segment(s["netloc"]).alias("host"), parts.alias("parts"))

    def placed(i: Column, x: Column) -> Column:
        leaf = F.coalesce(F.element_at(F.when(F.size(x["parts"]) > 0, x["parts"]), -1), F.lit("index"))
        stem = F.regexp_replace(leaf, r"^(.+)\.[^.]*$", "$1")
        name = F.concat(F.substring(safe_segment(stem), 1, 70), F.lit("-"), F.substring(F.sha2(i, 256), 1, 10), F.lit(".md"))
        if layout == "flatten_all":
            return name
        where = F.transform(F.reverse(F.split(x["host"], r"\.")), safe_segment) if layout == "hierarchical" else F.array(x["host"])
        if layout != "flatten_domain":
            where = F.concat(where, F.slice(x["parts"], F.lit(1), F.greatest(F.size(x["parts"]) - 1, F.lit(0))))
        return F.concat_ws("/", where, F.array(name))

    return let(identity_, lambda i: F.when(i.isNotNull(), let(let(split_url(i), pieces), lambda x: placed(i, x))))


def relative_path(target: Column, source: Column) -> Column:
    """The target's path as seen from the folder of the source; both below one root."""
    t, s = F.split(target, "/"), F.split(F.regexp_extract(source, r"^(?:(.*)/)?[^/]*$", 1), "/")
    s = F.filter(s, lambda x: x != "")
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(s), F.size(t) - 1), F.lit(1))), lambda k: (k <= F.size(s)) & (k < F.size(t)) & (F.slice(s, F.lit(1), k) == F.slice(t, F.lit(1), k))))
    return F.concat_ws("/", F.array_repeat(F.lit(".."), F.size(s) - same), F.slice(t, same + 1, F.size(t)))


def parse_srcset(value: Column) -> Column:
    """Array of structs of url and descriptor."""
    text = F.trim(F.coalesce(value, F.lit("")))
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    listed = F.transform(
        parts,
        lambda p: F.struct(F.regexp_extract(p, r"^(\S+)", 1).alias("url"), F.nullif(F.regexp_replace(p, r"^\S+\s*", ""), F.lit("")).alias("descriptor")),
    )
    return F.when(F.lower(text).startswith("data:"), F.array(F.struct(text.alias("url"), F.lit(None).cast("string").alias("descriptor")))).otherwise(listed)


def format_srcset(candidates: Column) -> Column:
    return F.array_join(F.transform(candidates, lambda c: F.concat_ws(" ", c["url"], c["descriptor"])), ", ")


def check_crawl_policy(max_depth: int = 3, max_pages: int = 100, delay: float = 0.0, rate_limit: int | None = None, rule: str = "domain-only") -> None:
    """Refuses what a crawl cannot run with, before any job starts."""
    if max_depth < 0:
        raise ValueError("max_depth must not be negative")
    if max_pages <= 0:
        raise ValueError("max_pages must be positive")
    if not math.isfinite(delay) or delay < 0:
        raise ValueError("delay must be finite and not negative")
    if rate_limit is not None and rate_limit <= 0:
        raise ValueError("rate_limit must be positive")
    compile_scope(rule)


# ---- the same in SQL, for the oracles --------------------------------------------------------------------------------


def sql_parts(table: str, column: str = "url") -> str:
    """A SELECT that adds sch, net, pat, qry, frg, usr, host, port to the rows of a table."""
    u = f"regexp_replace(regexp_replace({column}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"
    p = SPLIT.replace("'", "''")
    a = "regexp_replace(net, '^.*@', '')"
    return f"""SELECT *, lower(CASE WHEN starts_with({a}, '[') THEN regexp_extract({a}, '^\\[([^\\]]*)\\]', 1) ELSE regexp_extract({a}, '^([^:]*)', 1) END) host,
  nullif(regexp_replace(CASE WHEN starts_with({a}, '[') THEN regexp_extract({a}, '^\\[[^\\]]*\\](.*)$', 1) ELSE regexp_replace({a}, '^[^:]*', '') END, '^:', ''), '') port,
  CASE WHEN contains(net, '@') THEN regexp_extract(net, '^(.*)@', 1) END usr
FROM (SELECT *, lower(regexp_extract({u}, '{p}', 1)) sch, regexp_extract({u}, '{p}', 2) net, regexp_extract({u}, '{p}', 3) pat,
  regexp_extract({u}, '{p}', 4) qry, regexp_extract({u}, '{p}', 5) frg FROM {table})"""


SQL_PORT_OK = "(port IS NULL OR coalesce(regexp_matches(port, '^[0-9]{1,9}$') AND try_cast(port AS INT) <= 65535, false))"
SQL_IDENTITY = f"""CASE WHEN sch IN ('http', 'https') AND usr IS NULL AND host <> '' AND {SQL_PORT_OK}
  AND regexp_matches(host, '^[^.]{{1,63}}(\\.[^.]{{1,63}})*\\.?$') THEN sch || '://' || regexp_replace(host, '\\.+$', '') ||
  CASE WHEN try_cast(port AS INT) IS NULL OR try_cast(port AS INT) = CASE sch WHEN 'https' THEN 443 ELSE 80 END THEN '' ELSE ':' || try_cast(port AS INT) END ||
  CASE pat WHEN '' THEN '/' ELSE pat END || CASE qry WHEN '' THEN '' ELSE '?' || qry END END"""


def sql_safe(value: str) -> str:
    decoded = f"url_decode({value})"
    return f"coalesce(nullif(regexp_replace(regexp_replace(trim({decoded}), '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g'), ''), '_')"


def sql_output_path(layout: str = "default") -> str:
    """An expression over identity and the identity's net and pat."""
    leaf = f"CASE WHEN len(segs) > 0 THEN {sql_safe('segs[-1]')} ELSE 'index' END"
    stem = f"regexp_replace({leaf}, '^(.+)\\.[^.]*$', '\\1')"
    name = f"substr({sql_safe(stem)}, 1, 70) || '-' || substr(sha256(identity), 1, 10) || '.md'"
    if layout == "flatten_all":
        return f"CASE WHEN identity IS NOT NULL THEN {name} END"
    where = f"[{sql_safe('x')} FOR x IN list_reverse(string_split({sql_safe('net')}, '.'))]" if layout == "hierarchical" else f"[{sql_safe('net')}]"
    if layout != "flatten_domain":
        where = f"list_concat({where}, [{sql_safe('x')} FOR x IN segs[:-2]])"
    return f"CASE WHEN identity IS NOT NULL THEN array_to_string(list_append({where}, {name}), '/') END"


SQL_SEGMENTS = "[s FOR s IN string_split(pat, '/') IF s <> ''] segs"
