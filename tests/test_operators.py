"""Small frames for edges that the queries do not reach."""

import datetime as dt

from pyspark.sql import functions as F

from gigledger.functions import geo, text
from gigledger.operators import filters, images, matching, review, tickets, upsert, windows
from gigledger.sources import bodies, sheets, sinks, snapshots


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_text(spark):
    cases = [
        (text.dedupe_text("x"), "The Band & Co's LIVE Show!", "band and cos"),
        (text.dedupe_text("x"), None, ""),
        (text.place_name("x"), "Café Ñandú, LLC", "cafe nandu"),
        (text.region_key("x"), "  St. Louis  ", "st-louis"),
        (text.region_key("x"), " ", "unknown"),
        (text.event_url("x"), "HTTPS://A.Example.com/e/?utm_source=1&b=2&a=1#f", "https://a.example.com/e?b=2&a=1"),
        (text.event_url("x"), "not a url", "not a url"),
        (text.source_url("x"), "https://user@A.Example.com:8080/c/?z=1&utm_x=2&a=3", "https://a.example.com/c?a=3&z=1"),
        (text.redact("x"), "u?api_key=abc&x=1 Bearer ab.cd", "u?api_key=[redacted]&x=1 Bearer [redacted]"),
        (text.neutral_cell("x"), " =1+1", "'=1+1"),
        (text.people("x"), "A, B; C + D with E", ["A", "B", "C", "D", "E"]),
        (text.url_flags("x"), "http://192.168.0.1/", ["dangerous_url"]),
        (text.number("x"), "1,234.5", 1234.5),
        (text.number("x"), "nan", None),
        (text.truth("x"), " YES ", True),
        (text.free_date("x"), "Show: Jan 3", None),
        (text.free_date("x"), "Show on 7/4/2026 at 7:30 PM", dt.datetime(2026, 7, 4, 19, 30)),
        (text.free_date("x"), "3 March 2026", dt.datetime(2026, 3, 3)),
        (text.free_date("x"), "2026-03-03T21:05:07", dt.datetime(2026, 3, 3, 21, 5, 7)),
    ]
    for column, value, want in cases:
        assert one(spark, column, value) == want, value


def test_ticket_ladder(spark):
    cases = {
        None: ("blank", False, 0),
        "tickets": ("suspicious", False, 5),
        "https://www.eventbrite.com/checkout-external?e=1": ("platform_generic_or_app", False, 18),
        "https://www.ticketmaster.com/": ("platform_generic_or_app", False, 20),
        "https://www.ticketmaster.com/x/event/1?utm_source=a": ("platform_event", True, 72),
        "https://dice.fm/event/x": ("platform_event", True, 78),
        "https://www.axs.com/events/1": ("platform_event", True, 82),
        "https://www.axs.com/": ("platform_generic_or_app", False, 24),
        "https://bit.ly/tix1": ("redirect_or_handoff", True, 68),
        "https://bit.ly/abc": ("unresolved", False, 28),
        "https://x.example.com/cart/1": ("suspicious", False, 12),
        "https://x.example.com/buy/1": ("direct", True, 92),
        "https://x.example.com/calendar": ("non_ticket", False, 30),
        "https://x.example.com/y": ("unresolved", False, 42),
    }
    for url, want in cases.items():
        got = one(spark, tickets.assess(F.col("x")), url)
        assert (got.category, got.usable, got.score) == want, url


def test_grid_join_equals_all_pairs(spark):
    import random

    r = random.Random(1)
    rows = [(i, r.uniform(40, 40.02), r.uniform(-1e-3, 0.02)) for i in range(150)] + [(500, None, 1.0), (501, 40.0, None)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double")
    got = {(x.id, x.other) for x in matching.near_pairs(df, df.withColumnRenamed("id", "other"), 200.0, "id", "other").collect()}
    pairs = df.alias("a").crossJoin(df.alias("b")).where(geo.haversine("a.lat", "a.lng", "b.lat", "b.lng") <= 200.0)
    assert got == {(x[0], x[3]) for x in pairs.collect()} and len(got) > 150


def test_grid_join_meets_across_the_date_line_and_the_poles(spark):
    import random

    r = random.Random(2)
    rows = [(i, lat + r.uniform(-0.004, 0.004), (lng + r.uniform(-0.006, 0.006) + 180) % 360 - 180) for i, (lat, lng) in enumerate(((0, 180), (60, -179.999), (85, 10), (-84.9, 179.999), (89.999, 0), (89.999, 120), (-90, -60), (-89.9995, 100)) * 20)]
    rows = [(i, max(-90.0, min(90.0, lat)), lng) for i, lat, lng in rows] + [(900, 89.9999, 0.0), (901, 89.9999, 179.0), (902, -90.0, 5.0), (903, -90.0, -170.0), (904, 0.0, 180.0), (905, 0.0, -180.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double")
    for metres in (120.0, 2000.0):
        got = {(x.id, x.other) for x in matching.near_pairs(df, df.withColumnRenamed("id", "other"), metres, "id", "other").collect()}
        pairs = df.alias("a").crossJoin(df.alias("b")).where(geo.haversine("a.lat", "a.lng", "b.lat", "b.lng") <= metres)
        assert got == {(x[0], x[3]) for x in pairs.collect()} and {(900, 901), (902, 903), (904, 905)} <= got


def test_affiliates_and_source_keys(spark):
    from gigledger.operators import taxonomy

    got = one(spark, tickets.assess(F.col("x")), "https://go.pxf.io/c/9?utm_source=a")
    assert (got.category, got.usable, got.score, got.repair, got.flags) == ("redirect_or_handoff", False, 32, "resolve_affiliate_handoff", ["affiliate/tracking domain", "tracking parameter"])
    assert one(spark, taxonomy.source_key(F.col("x")), "https://evyy.net/x") == "affiliate-networks" and one(spark, taxonomy.source_key(F.col("x")), "Sofar") == "sofar-sounds"


def test_merge_is_idempotent_and_blind_to_order(spark):
    policy = {"name": "fill", "score": "raise", "status": "replace"}
    golden = spark.createDataFrame([(1, "", 1.0, "a"), (2, "n", None, None)], "k long, name string, score double, status string")
    new = spark.createDataFrame([(1, "x", 0.5, "b"), (3, "y", 2.0, " "), (2, None, 4.0, "")], "k long, name string, score double, status string")
    first = upsert.merge_fields(golden, new, "k", policy)
    got = {r.k: (r.name, r.score, r.status, r.action, r.changed) for r in first.collect()}
    assert got == {1: ("x", 1.0, "b", "updated", ["name", "status"]), 2: ("n", 4.0, None, "updated", ["score"]), 3: ("y", 2.0, " ", "created", [])}
    again = upsert.merge_fields(first.select("k", *policy), new, "k", policy)
    assert {r.k: r.action for r in again.collect()} == {1: "skipped", 2: "skipped", 3: "skipped"}


def test_look_back_counts_equal_times_and_not_itself(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("a", t), ("a", t), ("a", t + dt.timedelta(minutes=30)), ("a", t + dt.timedelta(hours=2)), (None, t), (None, t)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    got = sorted(r.n for r in windows.look_back(df, "k", "ts", 3600, "n").where("k is not null").collect())
    assert got == [0, 1, 1, 2] and {r.n for r in windows.look_back(df, "k", "ts", 3600, "n").where("k is null").collect()} == {0}


def test_bodies(spark):
    ics = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:A\\, b\nDTSTART;TZID=America/Chicago:20260801T200000\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY:no start\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY:Day\nDTSTART;VALUE=DATE:20260802\nEND:VEVENT\nEND:VCALENDAR"
    rss = "<rss><item><title>Gig on July 4, 2026 at 8 pm</title><link>u</link></item><item><title><![CDATA[Later]]></title><pubDate>x</pubDate></item></rss>"
    card = "<html><article class='event'><h2>Show &amp; tell</h2><time datetime='2026-05-01T20:00'>May</time><a href='/e/1'>x</a></article></html>"
    empty_ld = '<html><script type="application/ld+json">{"@type":"WebPage"}</script>' + card
    rows = [("i", ics, "text/calendar"), ("r", rss, "application/rss+xml"), ("h", card, "text/html"), ("f", empty_ld, "text/html"), ("n", None, None), ("x", "plain", "text/plain")]
    df = spark.createDataFrame(rows, "key string, body string, content_type string")
    got = sorted((r.key, r.extractor, r.title, str(r.starts)) for r in bodies.extract(df).collect())
    assert got == [
        ("f", "html", "Show & tell", "2026-05-01 20:00:00"),
        ("h", "html", "Show & tell", "2026-05-01 20:00:00"),
        ("i", "ics", "A, b", "2026-08-02 01:00:00"),
        ("i", "ics", "Day", "2026-08-02 00:00:00"),
        ("r", "rss", "Gig on July 4, 2026 at 8 pm", "2026-07-04 20:00:00"),
        ("r", "rss", "Later", "None"),
    ]
    assert bodies.extract(df.limit(0)).collect() == []


def test_jsonld_at_any_depth_and_links_of_a_page(spark):
    event = '{"@type":["Thing","https://schema.org/MusicEvent"],"name":" A &amp; b ","startDate":"2026-05-01","url":{"@id":"e/1"},"image":["",{"url":"//cdn.example.com/x.PNG?y"}],"performer":[[],"Solo"],"offers":[{"lowPrice":5,"highPrice":"9"}]}'
    deep = event
    for _ in range(4):
        deep = '[{"@type":"WebPage","@graph":[' + deep + "]}]"
    script = lambda j: f"<script type='application/ld+json'>{j}</script>"
    rows = [(1, script(deep)), (2, script("{") + script("[]") + script("null") + script('{"@type":7}')), (3, script('{"@type":"Event"}')), (4, script('{"@type":"SportsEvent","name":"x"}')), (5, None), (6, script('{"@type":"EVENT","startDate":"2026-01-02T10:00"}') * 2)]
    df = spark.createDataFrame(rows, "key long, body string").withColumn("url", F.lit("https://a.example.com/d/p?q"))
    got = {r.key: r for r in bodies.jsonld_events(df, url="url").collect()}
    assert sorted(got) == [1, 6]
    r = got[1]
    assert (r.name, str(r.starts), r.url, r.images, r.headliner, r.supporting_artists, r.price, r.errors) == ("A & b", "2026-05-01 00:00:00", "https://a.example.com/d/e/1", ["https://cdn.example.com/x.PNG?y"], "Solo", None, "5 9", [])
    assert got[6].errors == ["missing_name"] and bodies.jsonld_events(df, depth=3).where("key = 1").count() == 0
    page = "<a href='/x'>Concert hall</a><a href='/x'>again an event</a><a href=\"/shows/2\"><b>Two</b></a><a href='/about'>About</a><a class='c' href='https://b.example.com/'>Tickets</a>"
    links = bodies.page_links(spark.createDataFrame([(1, page), (2, ""), (3, None)], "key long, body string")).collect()
    assert [(x.position, x.href, x.text, x.reason, x.confidence) for x in links] == [(0, "/x", "Concert hall", "concert", 0.72), (1, "/shows/2", "Two", "show", 0.55), (2, "https://b.example.com/", "Tickets", "tickets", 0.55)]
    base = F.lit("https://a.example.com")
    urls = spark.createDataFrame([("x",), ("/x",), ("//c/x",), ("?x",), ("mailto:x",), (None,)], "u string").select(bodies.absolute_url(F.col("u"), base)).collect()
    assert [u[0] for u in urls] == ["https://a.example.com/x", "https://a.example.com/x", "https://c/x", "https://a.example.com?x", "mailto:x", None]


def test_sheets_and_sinks(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Category,Event Name,Headliner,Start Date,Timezone,Venue Name,City,State\n Concert ,\"A, b\nc\",H,2026-01-01,UTC,V,C,S\n,,,,,,,\n")
    rows = sheets.read_sheet(spark, str(tmp_path / "e.csv"), sheets.EVENT_SHEET).orderBy("row_number").collect()
    assert [(r.row_number, r["Event Name"], r.Category) for r in rows] == [(2, "A, b\nc", "Concert"), (3, None, None)]
    try:
        sheets.read_sheet(spark, str(tmp_path / "e.csv"), sheets.SOURCE_SHEET)
        raise AssertionError("a sheet without its columns must not be read")
    except ValueError as error:
        assert "Calendar URL" in str(error)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string")
    records = sinks.feed_records(df, "poi", "id", ["id", "name"]).unionByName(sinks.feed_records(df, "venue", "id", ["name"]))
    told = sorted(tuple(r) for r in sinks.manifest(records).collect())
    written = sorted(tuple(r) for r in sinks.write_feed(records.repartition(3), str(tmp_path / "feed"), "x1").collect())
    assert told == written and [r[1] for r in told] == [3, 3]


def test_board_and_image_filters(spark):
    event = spark.createDataFrame([(1, " Hall ", None, 12.0, 16.0, ["Missing address"]), (2, None, "Oslo", None, None, None)], "id long, title string, city string, lat double, lng double, venue_badges array<string>")
    rows = review.review_rows(event.withColumn("record_type", F.lit("normalized_event")))
    assert [(r.row_key, r.title, r.city, r.venue_badges, r.needs_review) for r in rows.orderBy("id").collect()] == [("normalized_event:1", "Hall", "", ["Missing address"], False), ("normalized_event:2", "", "Oslo", [], False)]
    ids = lambda **wishes: sorted(r.id for r in filters.review_board(rows, **wishes).collect())
    assert ids() == ids(search=" ", city="", tab="all") == [1, 2]
    assert ids(venue_status="missing_address") == ids(search="HALL") == ids(around=(12.0, 16.0, 1.0)) == [1]
    assert ids(around=(12.0, 16.0, 1.0), city="osl") == ids(location="oslo") == [2]
    assert ids(tab="api") == ids(date_from="2000-01-01") == []

    names = "status clearance is_accessible is_direct is_social evidence_only can_be_final generic_score text_score poster_score admat_score role is_poster has_text has_watermark has_logo is_stock is_food is_unrelated_place is_generic_crowd shows_artist shows_live shows_venue width height".split()
    kinds = {"status": "string", "clearance": "string", "role": "string", "width": "int", "height": "int", "generic_score": "double", "text_score": "double", "poster_score": "double", "admat_score": "double"}
    unknown = spark.range(1).select(*[F.lit(None).cast(kinds.get(n, "boolean")).alias(n) for n in names])
    assert unknown.select(images.blocking_reasons()).first()[0] == ["not direct image asset", "not eligible as final image"]
    crowd = unknown.withColumns({"is_direct": F.lit(True), "can_be_final": F.lit(True), "is_generic_crowd": F.lit(True), "width": F.lit(2000), "height": F.lit(399)})
    assert crowd.select(images.blocking_reasons()).first()[0] == ["generic crowd without music signal", "severe low resolution"]
    assert crowd.select(images.blocking_reasons(override=True)).first()[0] == []


def test_exports_are_told_apart_by_hashes_and_failures_stay_out(spark, tmp_path):
    folder = str(tmp_path / "x")
    made = lambda rows: snapshots.records(spark.createDataFrame(rows, "id long, name string"), "poi", "id", F.struct("id", "name"))
    assert snapshots.latest(snapshots.read_manifest(spark, folder)).collect() == [] and snapshots.snapshot(spark, folder, "pois").collect() == []
    first, second = made([(1, "a"), (2, "b"), (3, None)]), made([(1, "a"), (2, "c"), (4, "d")])
    assert snapshots.export(first, folder, "pois", "1", "2026-01-01 00:00:00") and not snapshots.export(second, folder, "nothing", "2", "2026-01-02 00:00:00")
    assert not snapshots.export(second.drop("hash"), folder, "pois", "3", "2026-01-03 00:00:00")
    diff = snapshots.changes(snapshots.snapshot(spark, folder, "pois"), second)
    assert sorted((r.id, r.change) for r in diff.collect()) == [("1", "unchanged"), ("2", "changed"), ("3", "withdrawn"), ("4", "new")]
    assert snapshots.export(second, folder, "pois", "4", "2026-01-04 00:00:00") and snapshots.export(first, folder, "venues", "5", "2026-01-05 00:00:00")
    newest = sorted((r.export_type, r.export_id, r.kind, r.records) for r in snapshots.latest(snapshots.read_manifest(spark, folder)).collect())
    assert newest == [("pois", "4", "poi", 3), ("venues", "5", "venue", 0)]
    assert {r.error is None for r in snapshots.read_manifest(spark, folder).where("status = 'failure'").collect()} == {False}
    assert sorted(spark.read.json(f"{folder}/feed/export_id=4").select("id", "name").collect()) == [(1, "a"), (2, "c"), (4, "d")]


def test_vendor_rules_take_the_first_path_that_has_text(spark):
    from gigledger.sources import vendors

    full = '{"identifier":"e1","name":" ","x-customTitle":"T","image":[" ","i"],"performer":{"name":"Solo","genre":"Jazz"},"offers":[{"category":"x","url":"https://bit.ly/tickets1"},{"category":"ticketingLinkSecondary","url":"https://hall.example.com/calendar"},7],"location":{"geo":{"latitude":"north"},"address":{"addressRegion":"ST"}},"x-externalIdentifiers":[{"identifier":"9"},{"source":"s"}]}'
    rows = spark.createDataFrame([(1, full), (2, "[1]"), (3, "{"), (4, None)], "key long, j string").withColumn("record", F.try_parse_json("j"))
    got = {r.key: r for r in vendors.vendor_events(rows, "performer_feed").collect()}
    r = got[1]
    assert (r.event_name, r.headliner, r.supporting_artists, r.tickets_link, r.ticket_class, r.latitude, r.state, r.upstream_source, r.upstream_id) == ("T", "Solo", None, "https://bit.ly/tickets1", "redirect_or_handoff", None, None, "s", "9")
    assert r.normalization_status == "failed" and r.completeness == 50.0 and sorted(got) == [1, 2, 3, 4] and got[4].completeness == 0.0
    made = lambda j: spark.createDataFrame([(j,)], "j string").select(vendors.classification(F.try_parse_json("j")).alias("c")).first().c
    c = made('{"classifications":[null,{"segment":{"segment":"MUSIC"},"genre":{"name":"Rock"},"subGenre":{"name":"Undefined"}}]}')
    assert (c.segment, c.music_category, c.normalized_genre, c.relevance, c.flags) == ("MUSIC", "Music", "Rock", 94.0, ["music_segment"])
    assert made("{}").relevance == made('{"classifications":[]}').relevance == 45.0 and made('{"segment":{"name":"Arts"}}').flags == ["non_music_segment", "low_event_relevance"]


def test_image_scores_of_bare_and_rich_rows(spark):
    bare = images.candidate_scores(spark.createDataFrame([(1, "artist_live"), (2, None)], "image_id long, role string")).orderBy("image_id").collect()
    # 28 or 5.6 for the role, 88 technical, 40 subject, 35 provenance, 50 approval
    assert [r.image_score for r in bare] == [round(28 + 21.12 + 8 + 5.6 + 6, 2), round(5.6 + 21.12 + 8 + 5.6 + 6, 2)] and bare[0].score_flags == ["missing dimensions"]
    rich = spark.createDataFrame([("rejected", "manual", 1600, 800), ("approved", "partner_supplied", 3000, 500)], "clearance string, source_type string, width int, height int").withColumn("role", F.lit("venue_live"))
    got = {r.clearance: (r.image_score, r.provenance_score, r.technical_score) for r in images.candidate_scores(rich).collect()}
    assert got == {"rejected": (0.0, 0.0, 100.0), "approved": (round(56 * 0.28 + 92 * 0.24 + 8 + 16 + 86 * 0.12, 2), 100.0, 92.0)}
    roles = spark.createDataFrame([(x,) for x in (" Headliner ", "press", "LOGO", "nonsense", None)], "r string").select(images.normal_role("r").alias("r")).collect()
    assert [r.r for r in roles] == ["artist_live", "artist_press", "logo", "unknown", "unknown"]
    uses = spark.createDataFrame([(1, 1, 7, "u?a", "venue_live"), (2, 2, 7, "U#b", "venue_live"), (3, 3, None, "u", "event"), (4, 9, None, "other", "event"), (5, None, None, None, "event")], "image_id long, event_id long, venue_id long, url string, role string")
    events = spark.createDataFrame([(1, "A", "t", 7), (2, "", "B", 7), (3, "a ", "t", 7)], "event_id long, headliner string, title string, venue_id long")
    got = {r.image_id: (r.reused_events, r.reasons) for r in images.reuse_reasons(uses, events).collect()}
    stock = ["reused across different headliners", "reused across three or more events"]
    assert got == {1: (3, []), 2: (3, []), 3: (3, stock), 4: (1, [])}
