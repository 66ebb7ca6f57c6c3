"""Queries of crawled bodies: nested JSON-LD, cards, links and the router. The bodies are derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import bodies
from ..sources.shared import spread
from .q_search import _ics, _rss
from .registry import register


def _event_json(of):
    """One event as JSON-LD: every shape of type, offers, performers and images occurs."""
    n = of("event_id")
    kind = F.when(n % 5 == 0, '["Thing","MusicEvent"]').when(n % 5 == 1, '"http://schema.org/Event"').when(n % 5 == 2, '["https://schema.org#Festival"]').when(n % 5 == 3, '"concert"').otherwise('"Event"')
    offer = F.concat(F.lit('{"@type":"Offer","url":"/buy/'), n.cast("string"), F.lit('","price":'), (n % 90).cast("string"), F.lit(',"priceCurrency":"EUR"}'))
    offers = F.when(n % 4 == 0, offer).when(n % 4 == 1, F.concat(F.lit('["none",'), offer, F.lit("]"))).when(n % 4 == 2, '"free"').otherwise("[]")
    performer = F.when(n % 3 == 0, F.concat(F.lit('{"name":"Lead '), n.cast("string"), F.lit('"}'))).when(n % 3 == 1, '["Ann",{"name":"Ben"},{"role":"x"},{"url":"Cy"}]').otherwise("null")
    image = F.when(n % 6 == 0, F.concat(F.lit('"/i/'), n.cast("string"), F.lit('.jpg"'))).when(n % 6 == 1, F.concat(F.lit('[{"url":"https://img.example.com/'), n.cast("string"), F.lit('.png"},"https://img.example.com/page.html",""]'))).otherwise("{}")
    return F.concat(
        F.lit('{"@type":'), kind, F.lit(',"@id":"#e'), n.cast("string"), F.lit('","name":'), F.to_json(F.struct(of("title").alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(of("title").alias("t")))) - 6),
        F.lit(',"startDate":"'), F.coalesce(F.date_format(of("start_ts"), "yyyy-MM-dd'T'20:30"), F.lit("some day")), F.lit('","location":{"@type":"Place","name":"'), of("location_text"), F.lit('","address":{"addressLocality":"Town '), (n % 7).cast("string"), F.lit('"},"geo":{"latitude":'), (n % 80).cast("string"), F.lit("}}"),
        F.lit(',"offers":'), offers, F.lit(',"performer":'), performer, F.lit(',"image":'), image, F.lit("}"),
    )


def _ld_pages(v):
    """Pages with one event each, up to six lists and graphs deep, beside objects that are none and a broken script."""
    one, n = _event_json(F.col), F.col("event_id")
    deep = F.when(n % 4 == 0, one).when(n % 4 == 1, F.concat(F.lit('{"@graph":[{"@type":"WebPage","name":"p"},'), one, F.lit("]}"))).when(n % 4 == 2, F.concat(F.lit('[[{"@type":["WebSite"],"@graph":[[{"@graph":['), one, F.lit("]}]]}]]"))).otherwise(F.concat(F.lit("[["), one, F.lit("],7,null]")))
    page = F.concat(F.lit('<html><script type="application/ld+json">{"broken":</script><script type="application/ld+json">'), deep, F.lit("</script><body>x</body></html>"))
    return spread(v("v_event")).select(n.alias("key"), page.alias("body"), F.lit("https://www.example.com/shows/index.html?p=1").alias("url"))


_TITLE = "nullif(trim(title), '')"
_LD = f"""select event_id as key, {_TITLE} as name, (start_ts + interval 1230 minutes)::varchar as starts, location_text as venue, 'Town ' || (event_id % 7)::varchar as city, (event_id % 80)::double as lat,
 'https://www.example.com/shows/index.html#e' || event_id::varchar as url,
 case when event_id % 4 < 2 then 'https://www.example.com/buy/' || event_id::varchar end as tickets_link, case when event_id % 4 < 2 then (event_id % 90)::varchar || ' EUR' end as price,
 case event_id % 3 when 0 then 'Lead ' || event_id::varchar when 1 then 'Ann' end as headliner, case when event_id % 3 = 1 then 'Ben, Cy' end as supporting_artists,
 case event_id % 6 when 0 then 'https://www.example.com/i/' || event_id::varchar || '.jpg' when 1 then 'https://img.example.com/' || event_id::varchar || '.png' else '' end as images,
 concat_ws(',', case when {_TITLE} is null then 'missing_name' end, case when start_ts is null then 'missing_start' end) as errors
from {{v_event}} where {_TITLE} is not null or start_ts is not null"""
register(
    "a08_jsonld_events",
    lambda v: bodies.jsonld_events(_ld_pages(v), url="url").select("key", "name", F.col("starts").cast("string").alias("starts"), "venue", "city", "lat", "url", "tickets_link", "price", "headliner", "supporting_artists", F.array_join("images", ",").alias("images"), F.array_join("errors", ",").alias("errors")),
    _LD,
)

# links of the given pages: what their first words make of them
_ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"''][^\"'']+[\"''][^>]*>.*?</a>"
register(
    "a09_page_links",
    lambda v: bodies.page_links(v("pages").select(F.col("page_id").alias("key"), F.regexp_replace("html", r'href="/(\p{L})', r'href="/music/$1').alias("body"), "url"), url="url").select("key", F.col("position").cast("long").alias("position"), "href", "text", "reason", "confidence"),
    rf"""select key, n - 1 as position, href, t as text, reason, case when reason in ('event', 'concert') then 0.72 else 0.55 end::double as confidence from (
select *, row_number() over (partition by key order by i) as n from (
select *, row_number() over (partition by key, href order by i) as first from (
select *, case when contains(said, 'event') then 'event' when contains(said, 'calendar') then 'calendar' when contains(said, 'concert') then 'concert' when contains(said, 'show') then 'show' when contains(said, 'music') then 'music' when contains(said, 'festival') then 'festival' when contains(said, 'tickets') then 'tickets' end as reason from (
select *, lower(href || ' ' || t) as said from (
select key, i, regexp_extract(url, '^https?://[^/?#]*') || regexp_extract(a, '(?is)^<a\s[^>]*?href\s*=\s*["'']([^"'']+)', 1) as href, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as t from (
select page_id as key, url, unnest(l) as a, unnest(range(1, len(l) + 1)) as i from (select page_id, url, regexp_extract_all(regexp_replace(html, 'href="/(\p{{L}})', 'href="/music/\1', 'g'), '{_ANCHOR}') as l from {{pages}}))))) where reason is not null) where first = 1) where n <= 50""",
)


def _card_pages(v):
    """Three events a page as cards, between blocks that are none; one page in five states its only date outside any card."""
    n = F.col("event_id")
    day = F.date_format("start_ts", "MMMM d, yyyy")
    heading = F.when(n % 3 == 0, F.concat(F.lit("<h3>"), F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("</h3>"))).otherwise(F.concat(F.lit('<a href="/buy-ticket/'), n.cast("string"), F.lit('">Buy now</a><a href="../event/'), n.cast("string"), F.lit('"> '), F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("</a>")))
    when = F.when(n % 2 == 0, F.concat(F.lit("<time datetime='"), F.date_format("start_ts", "yyyy-MM-dd'T'19:00"), F.lit("'>x</time>"))).otherwise(F.concat(F.lit("<p>On "), day, F.lit(" at 7 pm</p>")))
    tag = F.when(n % 4 == 0, "article").when(n % 4 == 1, "li").when(n % 4 == 2, "section").otherwise("div")
    card = F.concat(F.lit("<"), tag, F.when(n % 5 == 0, F.lit(' id="lineup-1" data-x="1">')).otherwise(F.lit(' class="row Event-Card">')), heading, when, F.lit('<span class="venue-name">'), F.col("location_text"), F.lit("</span><img src='/p.jpg'><img src='/spacer'></"), tag, F.lit(">"))
    rows = v("v_event").where("start_ts is not null and trim(title) <> ''").select(F.floor(n / 3).alias("key"), card.alias("card"))
    page = F.concat(F.lit('<html><body><div class="note">1 January 1999</div>'), F.array_join(F.collect_list("card"), "<p>and</p>"), F.lit("</body></html>"))
    return spread(rows, "key").groupBy("key").agg(page.alias("body")).select("key", "body", F.lit("http://hall.example.com/a/b/list").alias("url"))


register(
    "a09_page_cards",
    lambda v: bodies.page_cards(_card_pages(v), url="url").select("key", "title", F.col("starts").cast("string").alias("starts"), "venue", F.col("url").alias("link"), "tickets_link", F.array_join("images", ",").alias("images")),
    """select event_id // 3 as key, trim(title) as title, (start_ts + interval 19 hours)::varchar as starts, location_text as venue, case when event_id % 3 > 0 then 'http://hall.example.com/a/b/../event/' || event_id::varchar end as link,
 case when event_id % 3 > 0 then 'http://hall.example.com/buy-ticket/' || event_id::varchar end as tickets_link, 'http://hall.example.com/p.jpg' as images from {v_event} where start_ts is not null and trim(title) <> ''""",
)


def _mixed(v):
    """Bodies of every kind: calendars, feeds, JSON-LD pages, pages whose JSON-LD holds no event but which have cards, pages with links alone, and plain text."""
    ld = _ld_pages(v)
    typed = lambda d, mark, kind: d.select(F.concat(F.lit(mark), F.col("key").cast("string")).alias("key"), "body", F.lit(kind).alias("content_type"), (F.col("url") if "url" in d.columns else F.lit(None).cast("string")).alias("url"))
    empty = _card_pages(v).withColumn("body", F.concat(F.lit('<script type="application/ld+json">{"@type":"WebPage","name":"all"}</script>'), "body"))
    linked = v("v_venue").select(F.col("venue_id").alias("key"), F.concat(F.lit("<html><script type='application/ld+json'>[]</script><a href='/calendar/"), F.col("venue_id").cast("string"), F.lit("'>All dates</a><a href='/about'>About</a></html>")).alias("body"), F.lit("https://v.example.com").alias("url"))
    plain = v("v_region").select(F.col("region_id").alias("key"), F.lit("no markup at all").alias("body"))
    parts = [typed(_ics(v), "i", "text/calendar"), typed(_rss(v), "r", "text/xml"), typed(ld, "j", "text/html"), typed(empty, "c", "text/html"), typed(linked, "l", "text/html"), typed(plain, "p", "text/plain")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_ROUTED = f"""select 'ics' as extractor, count(*) as items, count(*) as dated, 0::bigint as linked, 0.95::double as confidence from {{v_event}} where start_ts is not null
union all select 'rss', count(*), count_if(event_id % 4 > 0)::bigint, count(*), 0.7 from {{v_event}} where start_ts is not null and {_TITLE} is not null
union all select 'json_ld', count(*), count(start_ts), count(*), 0.9 from {{v_event}} where {_TITLE} is not null or start_ts is not null
union all select 'html', count(*), count(*), count_if(event_id % 3 > 0)::bigint, 0.72 from {{v_event}} where start_ts is not null and {_TITLE} is not null
union all select 'html_links', count(*), 0, count(*), 0.55 from {{v_venue}}"""
register(
    "a11_routed_bodies",
    lambda v: bodies.extract(_mixed(v), url="url").groupBy("extractor").agg(F.count(F.lit(1)).alias("items"), F.count("starts").alias("dated"), F.count("link").alias("linked"), F.max("confidence").alias("confidence")),
    _ROUTED,
)
register(
    "a11_body_routes",
    lambda v: bodies.routed(_mixed(v), url="url").groupBy(F.substring("key", 1, 1).alias("made_as"), "extractor").agg(F.count(F.lit(1)).alias("bodies")),
    f"""select 'i' as made_as, 'ics' as extractor, count(*) as bodies from (select distinct venue_id, event_id // 1000 from {{v_event}} where start_ts is not null)
union all select 'r', 'rss', count(*) from (select distinct region_id, event_id // 1000 from {{v_event}} where start_ts is not null)
union all select 'j', case when {_TITLE} is not null or start_ts is not null then 'json_ld' else 'unsupported' end, count(*) from {{v_event}} group by 2
union all select 'c', 'html', count(distinct event_id // 3) from {{v_event}} where start_ts is not null and {_TITLE} is not null
union all select 'l', 'html_links', count(*) from {{v_venue}} union all select 'p', 'unsupported', count(*) from {{v_region}}""",
)
