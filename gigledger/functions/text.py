"""Column functions for names, keys, URLs and free text. Blank means null or white space only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and their plain forms, position by position.
ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūçñýÿÁÀÂÄÃÅĀÉÈÊËĒÍÌÎÏĪÓÒÔÖÕŌÚÙÛÜŪÇÑÝŸ"
PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuucnyyAAAAAAAEEEEEIIIIIOOOOOOUUUUUCNYY"
# Words without meaning in titles and artist names, legal suffixes of places.
TITLE_NOISE = ("the", "a", "an", "live", "concert", "show", "event")
ARTIST_NOISE = ("the", "official", "live")
LEGAL_SUFFIX = r"\b(llc|inc|ltd|corp|co|company)\b"
# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def clean(c) -> Column:
    """Trimmed text, null where blank."""
    return F.nullif(F.trim(c), F.lit(""))


def trimmed(c: Column) -> Column:
    """The same as clean, with its argument computed once also within lambdas."""
    return F.get(F.regexp_extract_all(c, F.lit(r"(?s)\A *([^ ](?:.*[^ ])?) *\z"), F.lit(1)), 0)


def is_blank(c) -> Column:
    return clean(c).isNull()


def flags(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in the given order; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def sorted_flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_sort(F.array_distinct(flags(*pairs)))


def _words(text: Column, noise: tuple[str, ...]) -> Column:
    words = F.split(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*noise)), " ")


def dedupe_text(c) -> Column:
    """Title or venue text for matching: lower case, & as and, no quotes, no filler words; blank as ''."""
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "&", " and ")
    return _words(F.regexp_replace(low, "['`´]", ""), TITLE_NOISE)


def artist_name(c) -> Column:
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "&", " and ")
    return _words(F.regexp_replace(low, "['`´]", ""), ARTIST_NOISE)


def artist_key(c) -> Column:
    return F.concat(F.lit("artist:"), F.substring(F.sha2(artist_name(c), 256), 1, 16))


def fold(c) -> Column:
    """Latin letters without accents."""
    return F.translate(c, ACCENTED, PLAIN)


def place_name(c) -> Column:
    """Place name without accents, other non-ASCII letters, legal suffixes and punctuation."""
    low = F.regexp_replace(F.lower(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^\x00-\x7F]", "")), "&", " and ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, LEGAL_SUFFIX, " "), "[^a-z0-9]+", " "))


def search_text(c) -> Column:
    return F.trim(F.lower(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^a-zA-Z0-9]+", " ")))


def region_key(*parts) -> Column:
    """Hyphenated lower-case key of the parts that are not blank; 'unknown' without any."""
    text = F.concat_ws("-", *[F.lower(clean(p)) for p in parts])
    key = F.trim(F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(key == "", F.lit("unknown")).otherwise(key)


def key_part(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def fixed5(c) -> Column:
    return F.format_string("%.5f", c)


def geo_key(lat, lng) -> Column:
    return F.when(F.col(lat).isNotNull() & F.col(lng).isNotNull(), F.concat(F.lit("lat:"), fixed5(F.col(lat)), F.lit("|lng:"), fixed5(F.col(lng))))


def hash_of(*parts) -> Column:
    """SHA-256 of the parts joined by |, null as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def venue_key(name, address, city, state, zip_code, country, lat, lng) -> Column:
    basis = F.concat_ws("|", *[key_part(F.col(p) if isinstance(p, str) else p) for p in (name, address, city, state, zip_code, country)])
    spot = F.when(F.col(lat).isNotNull() & F.col(lng).isNotNull(), F.concat(F.lit("|"), fixed5(F.col(lat)), F.lit(","), fixed5(F.col(lng))))
    return F.sha2(F.concat(basis, F.coalesce(spot, F.lit(""))), 256)


def _pairs(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("")), "&"), lambda p: p != "")


def _name(pair: Column) -> Column:
    return F.lower(F.substring_index(pair, "=", 1))


def event_url(c) -> Column:
    """Scheme and host in lower case, no trailing slash, no fragment, no tracking parameters; order kept."""
    url = F.trim(F.coalesce(c, F.lit("")))
    scheme, host = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.array_join(F.filter(_pairs(url), lambda p: ~_name(p).isin(*TRACKING)), "&")
    made = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when((scheme == "") | (host == ""), url).otherwise(made)


def source_url(c) -> Column:
    """Host only, no port or trailing slash, parameters sorted, utm_*, fbclid* and gclid* dropped."""
    url = F.coalesce(c, F.lit(""))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    kept = F.array_sort(F.filter(_pairs(url), lambda p: ~_name(p).rlike("^(utm_|fbclid|gclid)")))
    query = F.array_join(kept, "&")
    return F.concat(scheme, F.lit("://"), url_host(url), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def url_host(c) -> Column:
    """Host in lower case without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_flags(c) -> Column:
    """Why a URL is unsafe to fetch, without looking any name up."""
    url, host = F.trim(F.coalesce(c, F.lit(""))), url_host(c)
    private = host.rlike(r"^(127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    inside = (host == "localhost") | host.rlike(r"\.(local|internal|localhost|lan)$")
    return flags((~url.rlike("^(?i)https?://"), "invalid_url_scheme"), (host == "", "missing_url_hostname"), (private | inside, "dangerous_url"))


def people(c) -> Column:
    """Names split at commas, semicolons, line ends, ' + ' and ' with '."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;\n]| \+ | with "), lambda x: F.trim(x)), lambda x: x != "")


def urls(c) -> Column:
    """Web addresses of a field that separates several by $, | or line ends."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[$|\n]"), lambda x: F.trim(x)), lambda x: x.rlike("^https?://"))


def price_text(low, high, currency) -> Column:
    """'low-high CUR', 'low CUR' when equal, 'from low CUR', 'up to high CUR'; null without any price."""
    show = lambda x: F.format_string("%.2f", x)
    body = (
        F.when(low.isNotNull() & high.isNotNull(), F.when(low == high, show(low)).otherwise(F.concat(show(low), F.lit("-"), show(high))))
        .when(low.isNotNull(), F.concat(F.lit("from "), show(low)))
        .when(high.isNotNull(), F.concat(F.lit("up to "), show(high)))
    )
    return F.trim(F.concat_ws(" ", body, F.when(body.isNotNull(), clean(currency))))


def redact(c) -> Column:
    """Values of secrets in text and URLs hidden, their names kept."""
    named = F.regexp_replace(c, r"(?i)\b(api[_-]?key|token|secret|password|authorization)(\s*[=:]\s*)[^\s&,;]+", "$1$2[redacted]")
    return F.regexp_replace(named, r"(?i)\bbearer\s+[a-z0-9._\-]+", "Bearer [redacted]")


def neutral_cell(c) -> Column:
    """Trimmed cell that a spreadsheet will not run as a formula."""
    text = F.trim(c)
    return F.when(text.rlike("^[=+@]"), F.concat(F.lit("'"), text)).otherwise(text)


def lifecycle(status, raw) -> Column:
    """cancelled before postponed before rescheduled, else active."""
    text = F.lower(F.concat_ws(" ", F.coalesce(status, F.lit("")), F.coalesce(raw, F.lit(""))))
    return (
        F.when(text.contains("cancelled") | text.contains("canceled"), "cancelled")
        .when(text.contains("postponed"), "postponed")
        .when(text.contains("rescheduled"), "rescheduled")
        .otherwise("active")
    )


def truth(c) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.isin("true", "yes", "y", "1"), True).when(text.isin("false", "no", "n", "0"), False)


def number(c) -> Column:
    """Tolerant decimal: commas dropped, null where it is no finite number."""
    value = F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def free_date(c) -> Column:
    """First of ISO, m/d/yyyy, 'Month d, yyyy' and 'd Month yyyy' found in a text, with its time if any."""
    return bind(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), _free_date)


def _free_date(text: Column) -> Column:
    months = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    found = lambda pattern, i=0: F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)), 0)
    named = lambda pattern, form: F.date_format(F.try_to_timestamp(F.initcap(F.regexp_replace(found(pattern), r"[,\s]+", " ")), F.lit(form)), "yyyy-MM-dd")
    slash = r"\b(\d{1,2})/(\d{1,2})/(\d{4})"
    date = F.coalesce(
        found(r"\d{4}-\d{2}-\d{2}"),
        F.regexp_replace(found(slash), slash, "$3-$1-$2"),
        named(rf"(?i)\b{months}\s+\d{{1,2}},?\s+\d{{4}}", "MMMM d yyyy"),
        named(rf"(?i)\b\d{{1,2}}\s+{months}\s+\d{{4}}", "d MMMM yyyy"),
    )
    spoken = F.upper(F.regexp_replace(found(r"(?i)\d{4},?\s*(?:at\s+)?(\d{1,2}(?::\d{2})?\s*[ap]\.?m)", 1), r"[\s.]", ""))
    time = F.coalesce(found(r"\d{4}-\d{2}-\d{2}[T ](\d{2}:\d{2}(?::\d{2})?)", 1), F.date_format(F.try_to_timestamp(spoken, F.lit("h[:mm]a")), "HH:mm"), F.lit("00:00"))
    return bind(date, lambda d: F.when(d.isNotNull(), F.try_to_timestamp(F.concat(d, F.lit(" "), time), F.lit("yyyy-M-d HH:mm[:ss]"))))
