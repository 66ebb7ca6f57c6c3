"""Ticket links: class, usability, score, flags, and the best of several."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind, flags, url_host
from .taxonomy import AFFILIATES

# Hosts of ticket platforms, of link shorteners, and what path parts mean.
PLATFORMS = (
    "bandsintown.com", "axs.com", "ticketweb.com", "tixr.com", "etix.com", "eventim.com", "seated.com", "seetickets.com", "seatgeek.com",
    "sofarsounds.com", "suitehop.com", "viagogo.com", "opendate.io", "universe.com", "skiddle.com", "humanitix.com", "tickettailor.com",
    "buytickets.at", "showpass.com", "ovationtix.com", "holdmyticket.com", "ticketnetwork.com", "mercurywebservices.com", "vividseats.com",
    "prekindle.com", "tixtrack.com", "nliven.co", "zeffy.com", "eventvesta.com", "outhousetickets.com", "venuepilot.com", "biletix.com",
    "speakeasygo.com", "eventnoire.com", "my805tix.com", "805tix.com", "24tix.com", "simpletix.com", "tix.com", "ticketleap.com", "aftontickets.com",
    "aftonshows.com", "instantseats.com",
)
SHORTENERS = ("bit.ly", "tinyurl.com", "linktr.ee", "lnk.to", "seetickets.us")
EVENT_PATHS = ("/e/", "/event", "/events", "/ticket", "/tickets", "/show", "/series", "/performance", "/whats-on")
CATEGORIES = ("direct", "redirect_or_handoff", "platform_event", "platform_generic_or_app", "non_ticket", "blank", "suspicious", "unresolved")


def _any(c: Column, tokens) -> Column:
    return c.rlike("|".join(t.replace(".", r"\.") for t in tokens))


def assess(c) -> Column:
    """Struct (category, usable, score, flags, repair) of a link.

    Affiliate hand-offs are never usable; tracking parameters cost 12 points of a link that is not
    refused. repair names what to do with the link.
    """
    url = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(url)
    parts = F.struct(
        low.alias("low"),
        F.regexp_replace(url_host(url), r"^www\.", "").alias("host"),
        F.regexp_extract(low, r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(low, r"\?([^#]*)", 1).alias("query"),
    )
    return bind(parts, lambda p: bind(_ladder(p["low"], p["host"], p["path"]), lambda found: _result(found["category"], found["score"], found["repair"], p["low"], p["query"], p["host"])))


def link_class(c) -> Column:
    """Struct (category, score, repair) of a link, as assess has them but for what tracking costs of the score."""
    url = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(url)
    parts = F.struct(low.alias("low"), F.regexp_replace(url_host(url), r"^www\.", "").alias("host"), F.regexp_extract(low, r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    return bind(parts, lambda p: _ladder(p["low"], p["host"], p["path"]))


def is_usable(category: Column, repair: Column) -> Column:
    return category.isin("direct", "platform_event") | (repair == "keep_redirect_or_handoff")


def _of_domain(host: Column, domains) -> Column:
    """Whether a host is one of the domains or lies below one: its last labels are looked up, as many as a domain has."""
    by_labels: dict[int, list[str]] = {}
    for d in domains:
        by_labels.setdefault(d.count(".") + 1, []).append(d)
    return reduce(Column.__or__, [F.substring_index(host, ".", -n).isin(*ds) for n, ds in sorted(by_labels.items())])


def _result(category: Column, score: Column, repair: Column, low: Column, query: Column, host: Column) -> Column:
    tracking = [
        (query.rlike("(^|&)utm_"), "tracking parameter"),
        (query.rlike("(^|&)(fbclid|gclid)="), "click tracking parameter"),
        (query.rlike("(^|&)(aff|affid|affiliate|intsrc|cid)="), "affiliate/tracking parameter"),
    ]
    malformed, cart = (repair == "reject_malformed", "malformed ticket URL"), (_CART(low), "session/cart-like ticket URL")
    open_ = category.isin("direct", "platform_event") | ((category == "redirect_or_handoff") & (repair != "resolve_affiliate_handoff")) | ((category == "unresolved") & (score == 42))
    held = F.when(open_, flags(*tracking)).when(repair == "resolve_affiliate_handoff", flags(cart, (F.lit(True), "affiliate/tracking domain"), *tracking))
    held = held.when(repair == "reject_session_or_cart_url", flags(cart, *tracking)).when(repair == "reject_non_ticket", flags(*tracking)).otherwise(flags(malformed, (cart[0] & ~malformed[0] & (category != "blank"), cart[1])))
    usable = is_usable(category, repair)
    return bind(F.struct(F.array_sort(held).alias("flags")), lambda h: F.struct(
        category.alias("category"),
        usable.alias("usable"),
        (score - F.when(open_ & (F.size(h["flags"]) > 0), 12).otherwise(0)).alias("score"),
        h["flags"].alias("flags"),
        repair.alias("repair"),
    ))


def _CART(low: Column) -> Column:
    return low.rlike("cart|session|queueittoken|checkout-external")


def _ladder(low: Column, host: Column, path: Column) -> Column:
    on_platform = _of_domain(host, PLATFORMS)
    affiliate = _of_domain(host, AFFILIATES)
    ladder = [
        (low == "", "blank", 0, "api_backfill_required"),
        (~low.rlike("^https?://[^/?#]+"), "suspicious", 5, "reject_malformed"),
        (affiliate, "redirect_or_handoff", 32, "resolve_affiliate_handoff"),
        (host.contains("eventbrite.") & path.contains("/checkout-external"), "platform_generic_or_app", 18, "reject_checkout_external"),
        (host.rlike(r"(^|\.)link\.dice\.fm$"), "platform_generic_or_app", 18, "reject_generic_app_handoff"),
        (host.contains("ticketmaster.") & (path.isin("", "/") | path.rlike("/artist/|/discover|/browse|/music")), "platform_generic_or_app", 20, "reject_generic_platform_page"),
        (host.contains("ticketmaster.") & path.contains("/event/"), "platform_event", 84, "keep_platform_event"),
        (host.contains("eventbrite.") & path.contains("/e/"), "platform_event", 84, "keep_platform_event"),
        (host.endswith("dice.fm") & path.rlike("/events?/"), "platform_event", 78, "keep_platform_event"),
        (host.endswith("dice.fm"), "platform_generic_or_app", 20, "reject_generic_platform_page"),
        (on_platform & _any(path, EVENT_PATHS), "platform_event", 82, "keep_platform_event"),
        (on_platform, "platform_generic_or_app", 24, "reject_generic_platform_page"),
        ((host.isin(*SHORTENERS) | host.contains("redirect")) & low.rlike("ticket|tix"), "redirect_or_handoff", 68, "keep_redirect_or_handoff"),
        (host.isin(*SHORTENERS) | host.contains("redirect"), "unresolved", 28, "api_backfill_required"),
        (_CART(low), "suspicious", 12, "reject_session_or_cart_url"),
        (host.rlike("ticket|tix|boxoffice") | path.rlike("ticket|tix|buy"), "direct", 92, "keep_direct"),
        (low.rlike("calendar|homepage|about|venue"), "non_ticket", 30, "reject_non_ticket"),
    ]
    made = lambda name, points, repair: F.struct(F.lit(name).alias("category"), F.lit(points).alias("score"), F.lit(repair).alias("repair"))
    out = made("unresolved", 42, "api_backfill_required")
    for condition, name, points, repair in reversed(ladder):
        out = F.when(condition, made(name, points, repair)).otherwise(out)
    return out


def best_links(links: DataFrame, key: str, url: str, priority: str) -> DataFrame:
    """Per key the first usable link by priority, else the first that is not blank, else a blank one; ties by URL. repair says what to do with it."""
    seen = links.withColumn("a", assess(F.col(url)))
    rank = F.when(F.col("a.usable"), 0).when(F.col("a.category") != "blank", 1).otherwise(2)
    order = Window.partitionBy(key).orderBy(rank, F.col(priority), F.col(url).asc_nulls_last())
    return seen.withColumn("n", F.row_number().over(order)).where("n = 1").select(key, url, "a.category", "a.usable", F.col("a.score").alias("score"), F.col("a.repair").alias("repair"))
