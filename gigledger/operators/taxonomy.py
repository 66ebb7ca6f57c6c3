"""Source taxonomy: the key of a provider from its name or from a domain, affiliate networks first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bind, url_host

# Keys of the taxonomy, each with the domains that belong to it.
DOMAINS = (
    ("jambase", ("jambase.com",)),
    ("cityspark", ()),
    ("bandsintown", ("bandsintown.com",)),
    ("axs", ("axs.com",)),
    ("ticketmaster", ("ticketmaster.com",)),
    ("ticketweb", ("ticketweb.com",)),
    ("eventbrite", ("eventbrite.com",)),
    ("dice", ("dice.fm", "link.dice.fm")),
    ("etix", ("etix.com",)),
    ("eventim", ("eventim.com",)),
    ("seated", ("seated.com",)),
    ("see-tickets", ("seetickets.com", "seetickets.us")),
    ("seatgeek", ("seatgeek.com",)),
    ("sofar-sounds", ("sofarsounds.com",)),
    ("suitehop", ("suitehop.com",)),
    ("tixr", ("tixr.com",)),
    ("viagogo", ("viagogo.com",)),
    ("spotify", ("spotify.com",)),
    ("serpapi", ()),
    ("manual_json", ()),
    ("csv_upload", ()),
    ("ics", ()),
    ("unknown", ()),
    ("affiliate-networks", ("awin1.com", "evyy.net", "prf.hn", "pxf.io", "lusg.net", "partnerize.com", "impact.com")),
    ("opendate", ("opendate.io",)),
    ("universe", ("universe.com",)),
    ("skiddle", ("skiddle.com",)),
    ("humanitix", ("humanitix.com",)),
    ("ticket-tailor", ("tickettailor.com", "buytickets.at")),
    ("showpass", ("showpass.com",)),
    ("ovationtix-audienceview", ("ovationtix.com",)),
    ("holdmyticket", ("holdmyticket.com",)),
    ("ticketnetwork", ("ticketnetwork.com", "mercurywebservices.com")),
    ("vivid-seats", ("vividseats.com",)),
    ("prekindle", ("prekindle.com",)),
    ("tixtrack-nliven", ("tixtrack.com", "nliven.co")),
    ("zeffy", ("zeffy.com",)),
    ("eventvesta", ("eventvesta.com",)),
    ("outhouse-tickets", ("outhousetickets.com",)),
    ("venuepilot", ("venuepilot.com",)),
    ("biletix", ("biletix.com",)),
    ("speakeasygo", ("speakeasygo.com",)),
    ("eventnoire", ("eventnoire.com",)),
    ("my805tix", ("my805tix.com", "805tix.com")),
    ("twentyfour-tix", ("24tix.com",)),
    ("simpletix", ("simpletix.com",)),
    ("tix-com", ("tix.com",)),
    ("ticketleap", ("ticketleap.com",)),
    ("afton-tickets", ("aftontickets.com", "aftonshows.com")),
    ("instantseats", ("instantseats.com",)),
)
# Other names of keys.
ALIASES = (
    ("bit", "bandsintown"),
    ("bands in town", "bandsintown"),
    ("see tickets", "see-tickets"),
    ("see tickets us", "see-tickets"),
    ("see tickets uk", "see-tickets"),
    ("sofar", "sofar-sounds"),
    ("sofar sounds", "sofar-sounds"),
    ("manual", "manual_json"),
    ("audienceview", "ovationtix-audienceview"),
    ("ovationtix", "ovationtix-audienceview"),
    ("mercury web services", "ticketnetwork"),
    ("mercury", "ticketnetwork"),
    ("skybox", "vivid-seats"),
    ("vivid seats", "vivid-seats"),
    ("tixtrack", "tixtrack-nliven"),
    ("nliven", "tixtrack-nliven"),
    ("805tix", "my805tix"),
    ("24tix", "twentyfour-tix"),
    ("tix.com", "tix-com"),
    ("ticket tailor", "ticket-tailor"),
    ("ticket tailoring", "ticket-tailor"),
    ("afton tickets", "afton-tickets"),
)
AFFILIATES = dict(DOMAINS)["affiliate-networks"]


def _lookup(key: Column, pairs: list[tuple[str, str]]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in dict(reversed(pairs)).items() for x in pair]), key)


def key_from_text(c) -> Column:
    """The key that a name is, in any spelling with spaces, hyphens or underscores, or an alias of; else null."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    keys = [k for k, _ in DOMAINS]
    bare = lambda k: k.replace("-", "").replace("_", "")
    return bind(low, lambda t: F.coalesce(
        _lookup(F.replace(t, F.lit("_"), F.lit("-")), [(k, k) for k in keys]),
        _lookup(t, list(ALIASES)),
        _lookup(F.regexp_replace(t, "[ -]", ""), [(bare(k), k) for k in keys]),
    ))


def key_from_domain(c) -> Column:
    """The key that a URL's or domain's host belongs to: the longest known suffix decides, affiliate networks come first; else null.

    Hosts are looked up by their last two and three labels, so the cost does not grow with the table.
    """
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    host = F.regexp_replace(url_host(F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))), r"^www\.", "")
    pairs = [(d, k) for k, ds in sorted(DOMAINS, key=lambda e: e[0] != "affiliate-networks") for d in ds]
    last = lambda h, n: F.substring_index(h, ".", -n)
    return bind(host, lambda h: F.coalesce(_lookup(last(h, 2), pairs), _lookup(last(h, 3), pairs)))


def source_key(c) -> Column:
    """By name, else by domain, else unknown."""
    return F.coalesce(key_from_text(c), key_from_domain(c), F.lit("unknown"))
