"""Text and path expressions: Column in, Column out, all built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 27 accent foldings of search text.
ACCENTED = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# Letter runs and digit runs: blank, punctuation and letter/digit class
# changes all end a token.
TOKEN_PATTERN = r"\p{L}+|\p{N}+"

# ASCII punctuation trimmed from query terms.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambda functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(text: Column) -> Column:
    """Lower-case and drop the common Latin accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def analyze(text: Column) -> Column:
    """Index tokens of a text: folded letter runs and digit runs."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(fold(text), F.lit(TOKEN_PATTERN))


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column | str) -> Column:
    """Trim any white space, not only spaces."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"^\s+|\s+$", "")


def exact_phrase(query: Column) -> Column:
    """Text between the quotes of a fully quoted query, else null."""
    inner = F.regexp_extract(F.trim(query), r'(?s)^"(.*)"$', 1)
    return F.when(F.trim(inner) != "", inner)


def query_terms(query: Column) -> Column:
    """Folded whitespace-separated terms of at least two bytes."""
    parts = F.split(collapse_ws(query), " ")
    trimmed = F.transform(parts, lambda p: F.btrim(p, F.lit(ASCII_PUNCTUATION)))
    return F.transform(F.filter(trimmed, lambda p: F.octet_length(p) >= 2), fold)


def norm_path(path: Column) -> Column:
    """Forward slashes, no empty and no ``.`` segments."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.array_join(F.filter(parts, lambda p: (p != "") & (p != ".")), "/")


def norm_prefix(path: Column) -> Column:
    """``norm_path`` that keeps one trailing slash if the input had one."""
    base = norm_path(path)
    slashed = F.endswith(path, F.lit("/")) | F.endswith(path, F.lit("\\"))
    return F.when((base != "") & slashed, F.concat(base, F.lit("/"))).otherwise(base)


def has_scheme(target: Column) -> Column:
    return target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def percent_decode(text: Column) -> Column:
    """Decode ``%XX``; malformed escapes and ``+`` stay, bad UTF-8 keeps the input."""
    guarded = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")

    def checked(decoded: Column) -> Column:
        broken = decoded.isNull() | (
            F.contains(decoded, F.lit("\ufffd")) & ~F.contains(text, F.lit("\ufffd"))
            & ~F.contains(F.upper(text), F.lit("%EF%BF%BD")))
        return F.when(broken, text).otherwise(decoded)

    decoded = let(F.try_url_decode(F.replace(guarded, F.lit("+"), F.lit("%2B"))), checked)
    return F.when(F.contains(text, F.lit("%")), decoded).otherwise(text)


# A path with an empty or dotted segment beside the empty one before a leading slash.
_FOLDABLE = r"//|/\z|(?:\A|/)\.{1,2}(?:/|\z)"


def fold_dots(path: Column) -> Column:
    """Lexical ``.``/``..`` folding; ``..`` above the top is a no-op."""
    parts = F.split(path, "/")
    folded = F.aggregate(
        parts,
        F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when((p == "") | (p == "."), acc)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    lead = F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(_FOLDABLE), F.concat(lead, F.array_join(folded, "/"))).otherwise(path)


def split_target(target: Column) -> tuple[Column, Column]:
    """(path without query text, fragment or null) of a link target."""
    has_fragment = F.contains(target, F.lit("#"))
    path = F.substring_index(F.substring_index(target, "#", 1), "?", 1)
    fragment = F.when(has_fragment, F.substring(target, F.locate("#", target) + 1, F.length(target)))
    return path, fragment


def basename(path: Column) -> Column:
    """Last non-empty segment, or the path itself when there is none."""
    last = F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)
    return F.when(last == "", path).otherwise(last)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def parent_dir(relative_path: Column) -> Column:
    """Directory part of a relative path, empty at the root."""
    return F.regexp_extract(relative_path, r"^(.*)/[^/]*$", 1)


def portable_path(path: Column) -> Column:
    slashed = F.translate(path, "\\", "/")
    return (
        F.when(F.startswith(slashed, F.lit("//?/UNC/")), F.concat(F.lit("//"), F.substring(slashed, 9, 1 << 30)))
        .when(F.startswith(slashed, F.lit("//?/")), F.substring(slashed, 5, 1 << 30))
        .otherwise(slashed)
    )


def path_identity(path: Column) -> Column:
    """Comparable form: Windows drive and UNC paths fold case, trailing slashes drop."""
    windows = path.rlike(r"^[a-zA-Z]:[\\/]") | F.startswith(path, F.lit("\\\\"))
    norm = F.when(windows, F.lower(portable_path(path))).otherwise(F.translate(path, "\\", "/"))
    return F.when(F.length(norm) > 1, F.regexp_replace(norm, "/+$", "")).otherwise(norm)


def parent_path(path: Column) -> Column:
    """Parent of an absolute path for POSIX, drive, UNC and verbatim forms."""
    slashed = F.regexp_replace(F.translate(path, "\\", "/"), "/+$", "")
    head = F.regexp_extract(slashed, "(?s)^(.*)/[^/]*$", 1)
    cut = F.length(head)
    plain = (
        F.when(~F.contains(slashed, F.lit("/")), F.lit("."))
        .when(cut == 0, F.lit("/"))
        .when((cut == 2) & slashed.rlike("^[a-zA-Z]:/"), F.substring(slashed, 1, 3))
        .otherwise(head)
    )
    back = F.regexp_replace(F.translate(path, "/", "\\"), r"\\+$", "")
    vhead = F.regexp_extract(back, r"(?s)^(.*)\\[^\\]*$", 1)
    vcut = F.length(vhead)
    verbatim = (
        F.when((vcut == 6) & back.rlike(r"^\\\\\?\\[a-zA-Z]:\\"), F.substring(back, 1, 7))
        .when(vcut > 3, vhead)
        .otherwise(back)
    )
    return F.when(F.startswith(path, F.lit("\\\\?\\")), verbatim).otherwise(plain)


def freshness(stale_after: Column, as_of: Column | str) -> Column:
    """Text comparison of ISO dates against an explicit day."""
    today = F.lit(as_of) if isinstance(as_of, str) else as_of
    return (
        F.when(stale_after.isNull(), F.lit("unspecified"))
        .when(stale_after <= today, F.lit("stale"))
        .otherwise(F.lit("current"))
    )


def display_facet(value: Column) -> Column:
    """``humanReviewed`` → ``Human Reviewed``."""
    spaced = F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.substring(spaced, 2, 1 << 30))


def age_bucket(ts_ms: Column, now_ms: Column) -> Column:
    """now / Nm / Nh / Nd since an epoch-millisecond instant."""
    delta = F.greatest(F.lit(0).cast("long"), now_ms - ts_ms)

    def whole(unit: int) -> Column:
        return F.floor(delta / unit).cast("long").cast("string")

    return (
        F.when(delta < 60_000, F.lit("now"))
        .when(delta < 3_600_000, F.concat(whole(60_000), F.lit("m")))
        .when(delta < 86_400_000, F.concat(whole(3_600_000), F.lit("h")))
        .otherwise(F.concat(whole(86_400_000), F.lit("d")))
    )


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def escape_xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def escape_xml_attribute(text: Column) -> Column:
    text = escape_xml(text)
    for raw, safe in (('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def escape_command(text: Column) -> Column:
    """CI annotation escaping."""
    for raw, safe in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (":", "%3A"), (",", "%2C")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def escape_cell(text: Column) -> Column:
    """Markdown table cell escaping."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def url_safe_base64(text: Column) -> Column:
    """Unpadded URL-safe base64 of a text."""
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def url_safe_unbase64(text: Column) -> Column:
    """Inverse of ``url_safe_base64``; null for malformed input."""
    plain = F.translate(text, "-_", "+/")
    pad = F.repeat(F.lit("="), (F.lit(4) - F.length(plain) % 4) % 4)
    return F.try_to_binary(F.concat(plain, pad), F.lit("base64")).cast("string")


def surrogate_key(*parts: Column) -> Column:
    """Deterministic row key."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def days_before(as_of: str, days: int) -> Column:
    return F.date_format(F.date_sub(F.to_date(F.lit(as_of)), days), "yyyy-MM-dd")


def left_chars(text: Column, n: Column | int) -> Column:
    return F.left(text, n if isinstance(n, Column) else F.lit(n))


def spread(text: Column, k: int = 32) -> Column:
    """A deterministic salt of a text key, in ``[0, k)``."""
    return F.pmod(F.xxhash64(text), F.lit(k)).cast("int")
