"""Event extraction from crawled bodies: iCalendar, RSS/Atom, JSON-LD, HTML links and cards, and the router between them.

Every extractor is a job over a table of (key, url, body) rows and gives one row per found item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, clean, flags, free_date, trimmed


def _exploded(bodies: DataFrame, key: str, items: Column) -> DataFrame:
    # outer: else Spark infers a filter on the array's size and computes the array twice
    return bodies.select(key, F.explode_outer(items).alias("x")).where("x is not null").select(key, "x.*")


def ics_array(body: Column) -> Column:
    """Array of (uid, summary, location, starts, ends, all_day, zone) of VEVENTs with a summary and a start."""
    unfolded = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), "\r\n?", "\n"), "\n[ \t]", "")
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\n", " "), r"\\([,;\\])", "$1")

    def event(e: Column) -> Column:
        got = lambda name: trimmed(F.regexp_extract(e, rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1))
        zone = trimmed(F.regexp_extract(e, r"(?m)^DTSTART;[^:\n]*TZID=([^:;\n]+)", 1))

        def stamp(name: str) -> Column:
            local = lambda raw: F.coalesce(F.try_to_timestamp(F.regexp_replace(raw, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(raw, F.lit("yyyyMMdd")))
            return bind(got(name), lambda raw: F.when(raw.endswith("Z") | zone.isNull() | (F.length(raw) == 8), local(raw)).otherwise(F.to_utc_timestamp(local(raw), F.coalesce(zone, F.lit("UTC")))))

        return F.struct(
            got("UID").alias("uid"), plain(got("SUMMARY")).alias("summary"), plain(got("LOCATION")).alias("location"), stamp("DTSTART").alias("starts"), stamp("DTEND").alias("ends"), (F.length(got("DTSTART")) == 8).alias("all_day"), zone.alias("zone")
        )

    found = F.transform(F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1)), event)
    return F.filter(found, lambda e: e["summary"].isNotNull() & e["starts"].isNotNull())


def ics_events(bodies: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """(key, uid, summary, location, starts, ends, all_day, zone) of VEVENTs with a summary and a start.

    Lines are unfolded; a date alone is an all-day event, Z means UTC, TZID gives the zone, other
    times float (UTC).
    """
    return _exploded(bodies, key, ics_array(F.col(body)))


def _tag(c: Column, *names: str) -> Column:
    found = [trimmed(F.regexp_replace(F.regexp_extract(c, rf"(?is)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")) for n in names]
    return _entities(F.coalesce(*found))


def _entities(c: Column) -> Column:
    def resolved(x: Column) -> Column:
        out = x
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
            out = F.replace(out, F.lit(entity), F.lit(char))
        return F.when(x.contains("&"), out).otherwise(x)

    return bind(c, resolved)


def _tidy(c: Column) -> Column:
    """Text with entities resolved and runs of white space as one space; null where blank."""
    return trimmed(F.regexp_replace(_entities(c), r"\s+", " "))


def _bare(c: Column) -> Column:
    """The text between tags."""
    return _tidy(F.regexp_replace(c, "(?s)<[^>]+>", " "))


def absolute_url(url: Column, base: Column) -> Column:
    """The URL as seen from a page: whole ones stay, others take scheme, host or folder of the page."""
    return bind(url, lambda u: _absolute(u, base))


def _absolute(url: Column, base: Column) -> Column:
    at = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//[^/?#]*", 0)
    below = lambda f: F.concat(F.when(f.endswith("/"), f).otherwise(F.concat(at, F.lit("/"))), url)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 0), r"(?<=[^/]/)[^/]*$", "")
    return (
        F.when(base.isNull() | url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0), url))
        .when(url.startswith("/"), F.concat(at, url))
        .when(url.startswith("?") | url.startswith("#"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), url))
        .otherwise(bind(folder, below))
    )


def rss_array(body: Column) -> Column:
    """Array of (title, link, starts, only_published) of RSS items and Atom entries with a title."""

    def item(e: Column) -> Column:
        link = F.coalesce(_tag(e, "link"), clean(F.regexp_extract(e, r"(?i)<link[^>]*href=[\"']([^\"']+)", 1)))
        said = F.concat_ws(" ", _tag(e, "title"), _tag(e, "description", "summary", "content"))
        return bind(F.struct(free_date(said).alias("starts")), lambda x: dated(e, link, x["starts"]))

    def dated(e: Column, link: Column, starts: Column) -> Column:
        return F.struct(_tag(e, "title").alias("title"), link.alias("link"), starts.alias("starts"), (starts.isNull() & _tag(e, "pubDate", "published", "updated").isNotNull()).alias("only_published"))

    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?is)<(?:item|entry)(?:\s[^>]*)?>(.*?)</(?:item|entry)>"), F.lit(1))
    return F.filter(F.transform(found, item), lambda e: e["title"].isNotNull())


def rss_items(bodies: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """(key, title, link, starts, only_published) of RSS items and Atom entries; the date is read from title and description, never from when it was published."""
    return _exploded(bodies, key, rss_array(F.col(body)))


# The last part of a JSON-LD type that makes an object an event.
EVENT_TYPES = ("event", "musicevent", "festival", "concert")
DEPTH = 12  # lists and graphs within one another that a JSON-LD script is searched through


def _path(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is_object(v: Column) -> Column:
    return F.coalesce(_path(v, "$").startswith("{"), F.lit(False))


def _as_list(v: Column) -> Column:
    """A value's elements, or the value alone as a list."""
    return bind(v, lambda x: F.coalesce(_path(x, "$", "array<variant>"), F.when(x.isNotNull(), F.array(x))))


def _plain_text(v: Column) -> Column:
    """A scalar's text, or an object's name, url, @id or text."""
    named = F.coalesce(*[_tidy(_path(v, p)) for p in ("$.name", "$.url", '$["@id"]', "$.text")])
    return F.when(_is_object(v), named).otherwise(_tidy(_path(v, "$")))


def _first_text(v: Column) -> Column:
    """The first text of a value: of a list that of its first element that has one."""
    return bind(v, lambda x: bind(_path(x, "$", "array<variant>"), lambda listed: F.when(listed.isNotNull(), F.get(F.array_compact(F.transform(listed, _plain_text)), 0)).otherwise(_plain_text(x))))


def graph_nodes(scripts: Column, depth: int = DEPTH) -> Column:
    """Array of (v variant, open) of all objects of JSON texts that lists and @graph lists lead to, inner ones first.

    Level by level every open node becomes its elements, or its graph's elements and itself,
    closed; broken JSON gives nothing. Nodes below `depth` levels stay open.
    """
    opened = lambda a: F.transform(a, lambda y: F.struct(y.alias("v"), F.lit(True).alias("open")))
    closed = lambda v: F.array(F.struct(v.alias("v"), F.lit(False).alias("open")))

    def widen(x: Column) -> Column:
        inner = F.coalesce(_path(x["v"], '$["@graph"]', "array<variant>"), F.array().cast("array<variant>"))
        listed = _path(x["v"], "$", "array<variant>")
        return F.when(~x["open"], closed(x["v"])).when(listed.isNotNull(), opened(listed)).otherwise(F.concat(opened(inner), closed(x["v"])))

    nodes = opened(F.array_compact(F.transform(scripts, F.try_parse_json)))
    for _ in range(depth):
        nodes = F.flatten(F.transform(nodes, widen))
    return nodes


def jsonld_array(body: Column, base: Column | None = None, depth: int = DEPTH) -> Column:
    """Array of the events of a page's JSON-LD scripts, in the fields of jsonld_events."""
    base = F.lit(None).cast("string") if base is None else base
    scripts = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))

    def is_event(x: Column) -> Column:
        types = F.coalesce(_path(x["v"], '$["@type"]', "array<string>"), F.array(_path(x["v"], '$["@type"]')))
        return F.coalesce(F.exists(types, lambda t: F.lower(F.regexp_extract(t, r"([^/#]*)$", 1)).isin(*EVENT_TYPES)), F.lit(False))

    def event(x: Column) -> Column:
        v = x["v"]
        at = lambda p: _path(v, p, "variant")
        text = lambda p: _tidy(_path(v, p))
        url = lambda c: absolute_url(c, base)
        price = lambda offer: trimmed(F.concat_ws(" ", *[_tidy(_path(offer, f"$.{p}")) for p in ("price", "lowPrice", "highPrice", "priceCurrency")]))
        offer = bind(F.get(F.filter(_as_list(at("$.offers")), _is_object), 0), lambda o: F.struct(url(_first_text(_path(o, "$.url", "variant"))).alias("url"), price(o).alias("price")))
        lineup = lambda names: F.struct(F.get(names, 0).alias("headliner"), trimmed(F.array_join(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), ", ")).alias("support"))
        acts = bind(F.array_compact(F.transform(_as_list(at("$.performer")), _first_text)), lineup)
        images = F.filter(F.transform(F.array_compact(F.transform(_as_list(at("$.image")), _first_text)), url), lambda u: u.rlike(DIRECT_IMAGE))
        return bind(F.struct(offer.alias("offer"), acts.alias("acts")), lambda of: F.struct(
            text("$.name").alias("name"),
            free_date(_path(v, "$.startDate")).alias("starts"),
            free_date(_path(v, "$.endDate")).alias("ends"),
            url(F.coalesce(_first_text(at("$.url")), text('$["@id"]'))).alias("url"),
            text("$.location.name").alias("venue"),
            text("$.location.address.streetAddress").alias("address"),
            text("$.location.address.addressLocality").alias("city"),
            text("$.location.address.addressRegion").alias("state"),
            text("$.location.address.postalCode").alias("zip"),
            text("$.location.address.addressCountry").alias("country"),
            _path(v, "$.location.geo.latitude", "double").alias("lat"),
            _path(v, "$.location.geo.longitude", "double").alias("lng"),
            of["offer"]["url"].alias("tickets_link"),
            of["offer"]["price"].alias("price"),
            of["acts"]["headliner"].alias("headliner"),
            of["acts"]["support"].alias("supporting_artists"),
            text("$.organizer.name").alias("organizer"),
            text("$.eventStatus").alias("event_status"),
            F.coalesce(text('$["@id"]'), text("$.identifier")).alias("source_event_id"),
            F.coalesce(images, F.array().cast("array<string>")).alias("images"),
            _path(v, '$["@type"]').alias("type"),
        ))

    found = F.transform(F.filter(graph_nodes(scripts, depth), is_event), event)
    return F.filter(found, lambda e: e["name"].isNotNull() | e["starts"].isNotNull())


def jsonld_events(bodies: DataFrame, key: str = "key", body: str = "body", url: str | None = None, depth: int = DEPTH) -> DataFrame:
    """(key, name, starts, ends, url, venue, address, city, state, zip, country, lat, lng, tickets_link, price, headliner, supporting_artists, organizer, event_status, source_event_id, images, type, errors) of JSON-LD events.

    An event is an object one of whose types ends in event, musicevent, festival or concert, at any
    place that lists and @graph lists lead to (within `depth` levels). The first offer that is an
    object gives link and price, the first performer is the headliner, images are those that look
    like files. `url` names the column with the page's address, which makes relative links whole.
    Events with neither name nor start are left out; errors names what one of the two lacks.
    """
    found = _exploded(bodies, key, jsonld_array(F.col(body), F.col(url) if url else None, depth))
    return found.withColumn("errors", flags((F.col("name").isNull(), "missing_name"), (F.col("starts").isNull(), "missing_start")))


# Words that make a link look like an event's page, in the order in which they count.
LINK_TOKENS = ("event", "events", "calendar", "concert", "show", "shows", "music", "festival", "tickets")
# Words in the class or id of an element that make it an event card.
CARD_TOKENS = ("event", "calendar", "concert", "show", "lineup", "artist")
DIRECT_IMAGE = r"(?i)^https?://[^?#]+\.(jpe?g|png|webp|gif)([?#].*)?$"


def _anchors(html: Column, base: Column) -> Column:
    """Array of (href, text) of the links of a page, in page order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a>"), F.lit(0))
    href = lambda a: trimmed(_entities(F.regexp_extract(a, r"(?is)^<a\s[^>]*?href\s*=\s*[\"']([^\"']+)", 1)))
    return F.filter(F.transform(found, lambda a: F.struct(absolute_url(href(a), base).alias("href"), F.coalesce(_bare(a), F.lit("")).alias("text"))), lambda a: a["href"].isNotNull())


def _link_token(a: Column) -> Column:
    said = F.lower(F.concat_ws(" ", a["href"], a["text"]))
    return F.coalesce(*[F.when(said.contains(t), F.lit(t)) for t in LINK_TOKENS])


def links_array(body: Column, base: Column, most: int = 50) -> Column:
    """Array of (href, text, reason, confidence) of the first distinct event-like links, at most so many."""
    found = F.transform(_anchors(F.coalesce(body, F.lit("")), base), lambda a: F.struct(a["href"].alias("href"), a["text"].alias("text"), _link_token(a).alias("reason")))
    found = F.filter(found, lambda a: a["reason"].isNotNull())
    firsts = lambda held: bind(F.transform(held, lambda b: b["href"]), lambda hrefs: F.filter(held, lambda a, i: F.array_position(hrefs, a["href"]) == i + 1))
    first = bind(found, firsts)
    sure = lambda a: F.when(a["reason"].contains("event") | a["reason"].contains("concert"), 0.72).otherwise(0.55)
    return F.slice(F.transform(first, lambda a: F.struct(a["href"].alias("href"), a["text"].alias("text"), a["reason"].alias("reason"), sure(a).alias("confidence"))), 1, most)


def page_links(bodies: DataFrame, key: str = "key", body: str = "body", url: str | None = None, most: int = 50) -> DataFrame:
    """(key, position, href, text, reason, confidence) of the first distinct event-like links of each page, in page order, at most so many."""
    found = links_array(F.col(body), F.col(url) if url else F.lit(None).cast("string"), most)
    return bodies.select(key, F.posexplode(found).alias("position", "x")).select(key, "position", "x.*")


def cards_array(body: Column, base: Column) -> Column:
    """Array of (title, starts, venue, url, tickets_link, images) of event cards with a date; a page without any is one card if it has a date."""
    html = F.coalesce(body, F.lit(""))
    named = rf"[^>]*?\b(?:class|id)\s*=\s*[\"'][^\"']*(?:{'|'.join(CARD_TOKENS)})[^\"']*[\"'][^>]*"
    blocks = F.regexp_extract_all(html, F.lit(rf"(?is)<(article|li|section|div)\b{named}>.*?</\1>"), F.lit(0))

    def card(b: Column) -> Column:
        return bind(_anchors(b, base), lambda links: _card(b, links))

    def _card(b: Column, links: Column) -> Column:
        buys = lambda a: F.lower(a["text"]).contains("ticket") | F.lower(a["text"]).contains("buy")
        heading = F.get(F.array_compact(F.transform(F.regexp_extract_all(b, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)), _bare)), 0)
        link_text = F.get(F.filter(links, lambda a: (a["text"] != "") & ~buys(a)), 0)["text"]
        stated = trimmed(F.regexp_extract(b, r"(?is)<time[^>]*datetime\s*=\s*[\"']([^\"']+)", 1))
        venue = _bare(F.regexp_extract(b, r"(?is)<\w+\b[^>]*?\b(?:class|id)\s*=\s*[\"'][^\"']*(?:venue|location)[^\"']*[\"'][^>]*>(.*?)</", 1))
        page = F.get(F.filter(links, lambda a: _link_token(a).isNotNull() & ~F.lower(a["href"]).contains("ticket")), 0)["href"]
        ticket = F.get(F.filter(links, lambda a: F.lower(a["href"]).contains("ticket") | buys(a)), 0)["href"]
        images = F.transform(F.regexp_extract_all(b, F.lit(r"(?is)<img\s[^>]*?src\s*=\s*[\"']([^\"']+)"), F.lit(1)), lambda u: absolute_url(u, base))
        return F.struct(
            F.coalesce(heading, link_text).alias("title"),
            F.coalesce(free_date(stated), free_date(_bare(b))).alias("starts"),
            venue.alias("venue"), page.alias("url"), ticket.alias("tickets_link"),
            F.filter(images, lambda u: u.rlike(DIRECT_IMAGE)).alias("images"),
        )

    dated = lambda a: F.filter(F.transform(a, card), lambda c: c["starts"].isNotNull())
    found = dated(blocks)
    return bind(found, lambda f: F.when(F.size(f) > 0, f).otherwise(dated(F.array(html))))


def page_cards(bodies: DataFrame, key: str = "key", body: str = "body", url: str | None = None) -> DataFrame:
    """(key, title, starts, venue, url, tickets_link, images) of event cards.

    A card is an article, list item, section or div whose class or id names an event (to its first
    end tag of the kind: cards within cards are cut there) and that states a date; its title is the
    first heading, else the first link that sells no tickets. A page without cards is one card if it states a date.
    """
    return _exploded(bodies, key, cards_array(F.col(body), F.col(url) if url else F.lit(None).cast("string")))


def page_images(bodies: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """(key, source, url): og:image, twitter:image and JSON-LD images of a page."""
    text = F.coalesce(body, F.lit(""))
    meta = lambda name: F.concat(F.regexp_extract_all(text, F.lit(rf"(?i)<meta[^>]*(?:property|name)=[\"']{name}[\"'][^>]*content=[\"']([^\"']+)"), F.lit(1)), F.regexp_extract_all(text, F.lit(rf"(?i)<meta[^>]*content=[\"']([^\"']+)[\"'][^>]*(?:property|name)=[\"']{name}[\"']"), F.lit(1)))
    json = F.regexp_extract_all(text, F.lit(r'"image"\s*:\s*\[?\s*"([^"]+)'), F.lit(1))
    named = lambda source, urls: F.transform(urls, lambda u: F.struct(F.lit(source).alias("source"), u.alias("url")))
    found = F.concat(named("og_image", meta("og:image")), named("twitter_image", meta("twitter:image")), named("json_ld", json))
    return bodies.select(key, F.explode(F.array_distinct(found)).alias("x")).select(key, "x.source", "x.url")


def body_kind(content_type: Column, body: Column) -> Column:
    """ics, rss, json_ld, html or unsupported: what a body looks like."""
    kind, text = F.lower(F.coalesce(content_type, F.lit(""))), F.coalesce(body, F.lit(""))
    return (
        F.when(kind.contains("calendar") | text.contains("BEGIN:VCALENDAR"), "ics")
        .when(kind.rlike("rss|atom|/xml") | text.rlike(r"(?i)^\s*<(rss|feed)[\s>]"), "rss")
        .when(text.rlike(r"(?i)application/ld\+json"), "json_ld")
        .when(_html(kind, text), "html")
        .otherwise("unsupported")
    )


def _html(kind: Column, text: Column) -> Column:
    return kind.contains("html") | text.rlike("(?i)<(!doctype html|html|body|div|article|a)[\\s>]")


def routed(bodies: DataFrame, key: str = "key", body: str = "body", content_type: str = "content_type", url: str | None = None) -> DataFrame:
    """(key, extractor, items): one row per body with what the first extractor that finds anything makes of it.

    Calendars and feeds have one extractor. A page's JSON-LD comes first; a page where it yields
    nothing falls through to its cards, and one without cards to its event-like links. All of it is
    one pass over the bodies: a later extractor runs on the bodies that the earlier ones left empty.
    extractor is ics, rss, json_ld, html, html_links or unsupported; items are (title, starts,
    venue, link, tickets_link, confidence).
    """
    base = F.col(url) if url else F.lit(None).cast("string")
    text = F.col(body)
    none = F.lit(None).cast("string")

    def item(title, starts, venue=none, link=none, ticket=none, sure=None) -> Column:
        return F.struct(title.alias("title"), starts.alias("starts"), venue.alias("venue"), link.alias("link"), ticket.alias("tickets_link"), (F.lit(sure) if isinstance(sure, float) else sure).alias("confidence"))

    kinds = bodies.select(key, text.alias("_body"), base.alias("_url"), body_kind(F.col(content_type), text).alias("_kind"), F.coalesce(_html(F.lower(F.coalesce(content_type, F.lit(""))), text), F.lit(False)).alias("_html"))
    is_kind = lambda k: F.col("_kind") == k
    first = kinds.withColumn("_found", F.when(is_kind("ics"), F.transform(ics_array(F.col("_body")), lambda e: item(e["summary"], e["starts"], e["location"], sure=0.95)))
                             .when(is_kind("rss"), F.transform(rss_array(F.col("_body")), lambda e: item(e["title"], e["starts"], link=e["link"], sure=0.7)))
                             .when(is_kind("json_ld"), F.transform(jsonld_array(F.col("_body"), F.col("_url")), lambda e: item(e["name"], e["starts"], e["venue"], e["url"], e["tickets_link"], 0.9))))
    falls = (is_kind("html") | is_kind("json_ld") & F.col("_html")) & (F.coalesce(F.size("_found"), F.lit(0)) <= 0)
    second = first.withColumn("_cards", F.when(falls, F.transform(cards_array(F.col("_body"), F.col("_url")), lambda c: item(c["title"], c["starts"], c["venue"], c["url"], c["tickets_link"], 0.72))))
    third = second.withColumn("_links", F.when(F.size("_cards") == 0, F.transform(links_array(F.col("_body"), F.col("_url")), lambda a: item(clean(a["text"]), F.lit(None).cast("timestamp"), link=a["href"], sure=a["confidence"]))))
    held = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    extractor = F.when(held("_found"), F.col("_kind")).when(held("_cards"), "html").when(held("_links"), "html_links").when(is_kind("ics") | is_kind("rss"), F.col("_kind")).otherwise("unsupported")
    items = F.when(held("_found"), F.col("_found")).when(held("_cards"), F.col("_cards")).when(held("_links"), F.col("_links"))
    return third.select(key, extractor.alias("extractor"), items.alias("items"))


def extract(bodies: DataFrame, key: str = "key", body: str = "body", content_type: str = "content_type", url: str | None = None) -> DataFrame:
    """(key, extractor, title, starts, venue, link, tickets_link, confidence): one row per item of the extractor that `routed` chose for its body."""
    found = routed(bodies, key, body, content_type, url)
    return found.select(key, "extractor", F.explode_outer("items").alias("x")).where("x is not null").select(key, "extractor", "x.*")


def json_records(bodies: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """(key, position, record variant) of vendor JSON: a list, {events|data|results: []}, {event: {}} or one object; broken JSON gives no rows."""
    v = F.try_parse_json(F.col(body))
    from_path = lambda p: F.try_variant_get(F.col("v"), p, "array<variant>")
    many = F.coalesce(from_path("$"), from_path("$.events"), from_path("$.data"), from_path("$.results"))
    one = F.array(F.coalesce(F.try_variant_get(F.col("v"), "$.event", "variant"), F.col("v")))
    return bodies.withColumn("v", v).where("v is not null").select(key, F.posexplode(F.coalesce(many, one)).alias("position", "record"))
