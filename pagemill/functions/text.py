"""Text and Markdown functions as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.urls import SPLIT, let, split_url

REDACTED = "[REDACTED]"
#: Names of fields that carry secrets, and endings of such names.
SENSITIVE_KEYS = (
    "access_key", "access_token", "api_key", "apikey", "auth", "authorization", "client_assertion", "client_secret", "code", "cookie",
    "credential", "id_token", "jwt", "key", "password", "proxy_authorization", "refresh_token", "saml_response", "secret", "session",
    "session_token", "set_cookie", "sig", "signature", "state", "ticket", "token", "x_api_key", "x_amz_credential", "x_amz_security_token",
    "x_amz_signature", "x_goog_credential", "x_goog_signature",
)
SENSITIVE_SUFFIXES = ("_access_key", "_api_key", "_auth", "_credential", "_key", "_password", "_secret", "_signature", "_token")
#: The patterns of each redaction pass after that of addresses, with what replaces a match (Java's form).
_FIELDS = "access[_-]?token|refresh[_-]?token|session[_-]?token|api[_-]?key|client[_-]?secret|password|signature|credential|secret|token|code"
PASSES = (
    ("bearer", r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", f"Bearer {REDACTED}"),
    ("quoted_cookie", r"""(?i)(['"](?:set-cookie|cookie)['"]\s*:\s*['"])(.*?)(['"](?:\s*[,}]))""", f"$1{REDACTED}$3"),
    ("quoted_header", r"""(?i)(['"](?:authorization|proxy-authorization|x-api-key)['"]\s*:\s*['"])(.*?)(['"](?:\s*[,}]))""", f"$1{REDACTED}$3"),
    ("cookie_header", r"(?i)(\b(?:set-cookie|cookie)\s*[:=]\s*)([^\r\n]+)", f"$1{REDACTED}"),
    ("header", r"(?i)(\b(?:authorization|proxy-authorization|x-api-key)\s*[:=]\s*)([^\r\n]+)", f"$1{REDACTED}"),
    ("assignment", rf"""(?i)(['"]?(?:{_FIELDS}|sig|auth)['"]?\s*[:=]\s*['"]?)([^'"\s,;}}&]+)""", f"$1{REDACTED}"),
    ("query", rf"(?i)([?&](?:{_FIELDS}|key|sig|auth)=)[^&#\s]+", f"$1{REDACTED}"),
)
#: An address in a text, as the first redaction pass finds it.
ADDRESS = r"""(?i)https?://[^\s\p{Z}<>"']+"""
_BRACKETS = r"^([^@\[\]]*@)?\[[0-9a-fA-F:.]+\](:[^\[\]]*)?$"


def format_markdown(text: Column) -> Column:
    """Links into headings, HTML code blocks into fences, blank lines down to one."""
    # most texts have no empty link; possessive, as what the name takes is never given back
    text = F.when(F.contains(text, F.lit("[](#")), F.regexp_replace(text, r"(#{1,6} )([^\[]++)\[\]\((#[^\)]+)\)", "$1[$2]($3)")).otherwise(text)
    text = F.replace(F.replace(text, F.lit("<pre><code>"), F.lit("```\n")), F.lit("</code></pre>"), F.lit("\n```"))
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def nth_occurrence(text: Column, part: Column, n: int) -> Column:
    """Where the n-th occurrence begins, from 0, overlapping ones not counted; -1 where there is none."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)
    at = F.length(F.array_join(F.slice(pieces, F.lit(1), F.lit(n)), "")) + (n - 1) * F.length(part)
    return F.when((F.lit(n) > 0) & (part != "") & (F.size(pieces) > n), at).otherwise(-1)


def collapse(text: Column) -> Column:
    """White space runs to blanks, trimmed; blank: null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def json_string(text: Column) -> Column:
    """A JSON string literal with other characters than ASCII kept."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(c), F.lit(e))
    rest = [k for k in range(0x20) if chr(k) not in "\n\r\t\b\f"]
    out = F.when(out.rlike(r"[\x00-\x1F]"), reduce(lambda o, k: F.replace(o, F.lit(chr(k)), F.lit(f"\\u{k:04x}")), rest, out)).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def front_matter(**fields: Column) -> Column:
    """The populated fields in their fixed order between marker lines; empty without any."""
    order = ("title", "author", "date", "canonical_url", "description", "language")
    lines = F.concat_ws("\n", *[F.when(fields[k] != "", F.concat(F.lit(f"{k}: "), json_string(fields[k]))) for k in order if k in fields])
    return F.when(lines == "", "").otherwise(F.concat(F.lit("---\n"), lines, F.lit("\n---\n\n")))


def normalize_extracted(html: Column, title: Column) -> Column:
    """An extension's extract as a document of its own; null where it is blank."""
    low = F.lower(html)
    bare = (F.length(F.trim(html)) < 100) | ~(F.contains(low, F.lit("<html")) | F.contains(low, F.lit("<body")))
    whole = F.concat(F.lit("<!DOCTYPE html><html><head><title>"), F.coalesce(title, F.lit("")), F.lit("</title></head><body>"), html, F.lit("</body></html>"))
    return F.when(F.trim(html) == "", F.lit(None).cast("string")).when(bare, whole).otherwise(html)


def slug(title: Column) -> Column:
    """A download's file name."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^A-Za-z0-9_\s]", ""), r"\s+", "-"), 1, 50)


def sensitive_key(key: Column) -> Column:
    k = F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return k.isin(*SENSITIVE_KEYS) | k.rlike(f"({'|'.join(SENSITIVE_SUFFIXES)})$")


def redact_parameters(query: Column) -> Column:
    """Values of sensitive keys in a query string; separators stay as they are."""
    names = F.transform(F.split(query, "[&;]"), lambda p: F.struct(F.regexp_extract(p, "^([^=]*)=", 1).alias("k"), F.contains(p, F.lit("=")).alias("e"), p.alias("p")))
    fields = F.transform(
        names,
        lambda x: F.when(x["e"] & sensitive_key(F.coalesce(F.try_url_decode(x["k"]), x["k"])), F.concat(x["k"], F.lit(f"={REDACTED}"))).otherwise(x["p"]),
    )
    marks = F.concat(F.regexp_extract_all(query, F.lit("[&;]"), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(fields, marks, lambda f, m: F.concat(f, m)), "")


def redact_address(address: Column) -> Column:
    """An address without its userinfo and the values of its sensitive parameters; one that has none, or cannot be read, as it is."""

    def parts(s: Column) -> Column:
        net = F.regexp_replace(s["netloc"], "^.*@", f"{REDACTED}@")
        made = F.struct(net.alias("n"), redact_parameters(s["query"]).alias("q"), redact_parameters(s["fragment"]).alias("f"))
        tail = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")
        return let(
            made,
            lambda m: F.when(
                ((m["n"] != s["netloc"]) | (m["q"] != s["query"]) | (m["f"] != s["fragment"])) & (~s["netloc"].rlike(r"[\[\]]") | s["netloc"].rlike(_BRACKETS)),
                F.concat(s["scheme"], F.lit("://"), m["n"], s["path"], tail("?", m["q"]), tail("#", m["f"])),
            ).otherwise(address),
        )

    return let(split_url(address), parts)


def redact_addresses(text: Column) -> Column:
    """Userinfo and sensitive parameters of every address in a text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0)), redact_address)
    between = F.split(text, ADDRESS, -1)
    return F.when(F.contains(text, F.lit("://")), F.array_join(F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda b, a: F.concat(b, a)), "")).otherwise(text)


def redact_passes(text: Column, names: tuple[str, ...] | None = None) -> Column:
    """The passes after that of addresses, in their order."""
    for name, pattern, new in PASSES:
        if names is None or name in names:
            text = F.regexp_replace(text, pattern, new)
    return text


def redact(text: Column) -> Column:
    return redact_passes(redact_addresses(text))


def redact_mapping(values: Column) -> Column:
    """A map with sensitive keys' values replaced and the others redacted; null: empty."""
    return F.coalesce(F.transform_values(values, lambda k, v: F.when(sensitive_key(k), F.lit(REDACTED)).otherwise(redact(v))), F.create_map().cast("map<string,string>"))


#: The three date forms of HTTP.
HTTP_DATES = ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "EEEE, dd-MMM-yy HH:mm:ss 'GMT'", "EEE MMM d HH:mm:ss yyyy")


def parse_http_date(text: Column) -> Column:
    """Seconds since 1970, UTC; null where no form fits. The day's name is not read: Spark's parser cannot."""
    month = {m: k + 1 for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
    months = F.create_map(*[F.lit(x) for m, k in month.items() for x in (m, f"{k:02d}")])
    t = F.regexp_replace(F.trim(text), r"\s+", " ")
    forms = (
        (r"^[A-Za-z]{3}, (\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}:\d{2}:\d{2}) (?:GMT|UTC)$", 1, 2, 3, 4),
        (r"^[A-Za-z]{6,9}, (\d{2})-([A-Za-z]{3})-(\d{2}) (\d{2}:\d{2}:\d{2}) (?:GMT|UTC)$", 1, 2, 3, 4),
        (r"^[A-Za-z]{3} ([A-Za-z]{3}) (\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})$", 2, 1, 4, 3),
    )
    out = []
    for pattern, d, m, y, clock in forms:
        get = lambda k, p=pattern: F.regexp_extract(t, p, k)
        year = F.when(F.length(get(y)) == 2, F.concat(F.when(get(y).try_cast("int") >= 69, "19").otherwise("20"), get(y))).otherwise(get(y))
        stamp = F.concat(year, F.lit("-"), F.try_element_at(months, F.lower(get(m))), F.lit("-"), F.lpad(get(d), 2, "0"), F.lit(" "), get(clock))
        out.append(F.when(t.rlike(pattern), F.unix_seconds(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")))))
    return F.coalesce(*out)


def format_http_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait: a number, or a date less now; not below 0, null where it is neither."""
    number = F.when(F.trim(header).rlike(r"^[+-]?\d{1,18}$"), F.trim(header).try_cast("bigint"))
    return F.greatest(F.coalesce(number, (parse_http_date(header) - now).cast("bigint")), F.lit(0)) + F.when(F.coalesce(number, parse_http_date(header)).isNull(), F.lit(None).cast("bigint")).otherwise(0)


def content_type(headers: Column) -> Column:
    """Struct of media_type and charset of the first Content-Type header in a map."""
    raw = F.coalesce(F.try_element_at(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == "content-type")), F.lit(1)), F.lit(""))
    parts = F.transform(F.split(raw, ";"), lambda p: F.trim(p))
    sets = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.rlike(r"(?i)^charset\s*="))
    label = F.regexp_replace(F.trim(F.regexp_replace(F.try_element_at(sets, F.lit(-1)), r"^[^=]*=", "")), '^"+|"+$', "")
    return F.struct(F.lower(F.get(parts, F.lit(0))).alias("media_type"), F.nullif(label, F.lit("")).alias("charset"))


# ---- the same in SQL, for the oracles --------------------------------------------------------------------------------


def _sql_zip(pieces: str, marks: str) -> str:
    return f"array_to_string(list_transform(list_zip({pieces}, list_append({marks}, '')), lambda z: z[1] || z[2]), '')"


def sql_redact_parameters(query: str) -> str:
    key = "trim(regexp_replace(lower(url_decode(replace(regexp_extract(p, '^([^=]*)=', 1), '+', ' '))), '[^a-z0-9]+', '_', 'g'), '_')"
    listed = ", ".join(f"'{k}'" for k in SENSITIVE_KEYS)
    secret = f"contains(p, '=') AND ({key} IN ({listed}) OR regexp_matches({key}, '({'|'.join(SENSITIVE_SUFFIXES)})$'))"
    fields = f"list_transform(regexp_split_to_array({query}, '[&;]'), lambda p: CASE WHEN {secret} THEN regexp_extract(p, '^([^=]*)=', 1) || '={REDACTED}' ELSE p END)"
    return _sql_zip(fields, f"regexp_extract_all({query}, '[&;]')")


def sql_redact_addresses(text: str) -> str:
    part = lambda k: f"regexp_extract(a, '{SPLIT}', {k})"
    new = f"lower({part(1)}) || '://' || regexp_replace({part(2)}, '^.*@', '{REDACTED}@') || {part(3)}"
    for k, mark in ((4, "?"), (5, "#")):
        new += f" || CASE {part(k)} WHEN '' THEN '' ELSE '{mark}' || {sql_redact_parameters(part(k))} END"
    changed = " OR ".join([f"contains({part(2)}, '@')", *(f"{part(k)} <> {sql_redact_parameters(part(k))}" for k in (4, 5))])
    pattern = "'" + ADDRESS.replace("'", "''") + "'"
    found = f"list_transform(regexp_extract_all({text}, {pattern}), lambda a: CASE WHEN {changed} THEN {new} ELSE a END)"
    return _sql_zip(f"regexp_split_to_array({text}, {pattern})", found)
