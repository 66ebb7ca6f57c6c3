"""Queries of artists: claims matched by ids and names, and the registry with its links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import artists, genres
from ..sources.shared import tasks_for
from .q_columns import sql_artist, sql_genre
from .registry import register

_IDS = "case when artist_id % 11 = 0 then 'f' || (artist_id % 300)::varchar end as feed_artist_id, external_id as stream_artist_id, case when artist_id % 13 = 0 then 't' || (artist_id % 400)::varchar end as ticket_artist_id, case when artist_id % 17 = 5 then 'm' || (artist_id % 90)::varchar end as music_db_id"


def _named(v):
    n = F.col("artist_id")
    made = lambda when, mark, by: F.when(when, F.concat(F.lit(mark), (n % by).cast("string")))
    return v("v_artist").select("artist_id", "name", text.artist_name("name").alias("name_key"), F.array_compact(F.array(genres.genre("genre_text"), F.when(n % 4 == 0, "Live"))).alias("genres"), "label", made(n % 11 == 0, "f", 300).alias("feed_artist_id"), F.col("external_id").alias("stream_artist_id"), made(n % 13 == 0, "t", 400).alias("ticket_artist_id"), made(n % 17 == 5, "m", 90).alias("music_db_id"))


_NAMED = f"select artist_id, name, {sql_artist('name')} as name_key, {sql_genre('genre_text')} as g, artist_id % 4 = 0 as live, label, {_IDS} from {{v_artist}}"


def _sides(v):
    """Every artist as a claim, with a few names changed; the golden side has the first of each name."""
    rows = _named(v)
    golden = rows.where("name_key <> ''").groupBy("name_key").agg(F.min_by(F.struct("artist_id", "genres", *artists.IDS), "artist_id").alias("g")).select("name_key", "g.*")
    claims = rows.select(F.col("artist_id").alias("claim_id"), F.when(F.col("artist_id") % 7 == 0, F.concat("name_key", F.lit(" x"))).otherwise(F.col("name_key")).alias("name_key"), "genres", *artists.IDS)
    return claims, golden


_CLAIMS = "select *, case when artist_id % 7 = 0 then name_key || ' x' else name_key end as ck from {n}"
_GOLDEN = "select * from {n} where name_key <> '' qualify row_number() over (partition by name_key order by artist_id) = 1"
_KEYS = " union all ".join(f"select {{0}}, {i} as rank, {k} as key from {{1}} where {k} is not null" for i, k in enumerate(artists.IDS))
_D14 = f"""select claim_id, artist_id, case when rank < 4 then 0.98 when overlap then 0.82 when provided then 0.76 else 0.72 end::double as score, case rank when 0 then 'same_feed_artist_id' when 1 then 'same_stream_artist_id' when 2 then 'same_ticket_artist_id' when 3 then 'same_music_db_id' else case when overlap then 'name_and_genre' when provided then 'name_and_provider' else 'name' end end as reason
from (select b.claim_id, b.artist_id, b.rank, coalesce(c.g = g.g, false) or (c.live and g.live) as overlap, c.feed_artist_id is not null or c.stream_artist_id is not null or c.ticket_artist_id is not null as provided
from (select claim_id, rank, artist_id from ({_KEYS.format('artist_id as claim_id', '{c}')} union all select artist_id, 4, nullif(ck, '') from {{c}} where ck <> '') k
join (select rank, key, min(artist_id) as artist_id from ({_KEYS.format('artist_id', '{golden}')} union all select artist_id, 4, name_key from {{golden}}) group by 1, 2) i using (rank, key) qualify row_number() over (partition by claim_id order by rank, artist_id) = 1) b
join {{c}} c on c.artist_id = b.claim_id join {{golden}} g on g.artist_id = b.artist_id)"""
register("d14_artist_matches", lambda v: artists.match_artists(*_sides(v)), _D14, n=_NAMED, c=_CLAIMS, golden=_GOLDEN)


def _event_claims(v):
    """Every claim names its artist for its event."""
    parts = tasks_for(v("v_claim"), artists.CLAIMS)
    first = v("v_claim").repartition(parts, "claim_id").groupBy("claim_id").agg(*[F.min(c).alias(c) for c in ("event_id", "artist_id", "source_type", "source_id")])
    rows = first.repartition(parts, "artist_id").join(_named(v), "artist_id").drop("artist_id")
    n = F.col("claim_id")
    return rows.select(
        "claim_id", "event_id", "name", "name_key", "genres", "source_type", F.concat(F.lit("s"), (F.col("source_id") % 5).cast("string")).alias("source_url"), F.when(n % 10 == 1, "headliner").otherwise("supporting").alias("role"),
        F.when(n % 3 == 0, F.col("label")).when(n % 3 == 1, " ").alias("label"), *[F.when(n % 2 == 0, F.col(i)).alias(i) for i in artists.IDS],
    )


_EVENT_CLAIMS = "select c.claim_id, c.event_id, c.source_type, 's' || (c.source_id % 5)::varchar as source_url, case when c.claim_id % 10 = 1 then 'headliner' else 'supporting' end as role, case c.claim_id % 3 when 0 then a.label end as label, a.name, a.name_key, a.g, a.live, " + ", ".join(f"case when c.claim_id % 2 = 0 then a.{i} end as {i}" for i in artists.IDS) + " from (select claim_id, min(event_id) as event_id, min(artist_id) as artist_id, min(source_type) as source_type, min(source_id) as source_id from {v_claim} group by 1) c join {n} a using (artist_id) where a.name_key <> ''"
_ALL_KEYS = _KEYS.format("claim_id", "{ec}") + " union all select claim_id, 4, name_key from {ec}"
_FIRST = "select claim_id, coalesce(first_id, claim_id) as first_id from (select claim_id from {ec}) left join (select claim_id, first_id from (select k.claim_id, k.rank, f.first_id from {keys} k join (select rank, key, min(claim_id) as first_id from {keys} group by 1, 2) f using (rank, key) where f.first_id < k.claim_id) qualify row_number() over (partition by claim_id order by rank, first_id) = 1) using (claim_id)"
_HOPS = {f"h{i + 1}": f"select a.claim_id, b.first_id from {{h{i}}} a join {{h{i}}} b on b.claim_id = a.first_id" for i in range(6)}
_HELD = "select ec.*, h.first_id as artist_id from {ec} ec join {h6} h using (claim_id)"
_DEFINED = {"n": _NAMED, "ec": _EVENT_CLAIMS, "keys": _ALL_KEYS, "h0": _FIRST, **_HOPS, "held": _HELD}
_GENRES = "select artist_id, string_agg(genre, chr(44) order by k) as genres from (select artist_id, genre, min(claim_id * 2 + p) as k from (select artist_id, claim_id, g as genre, 0 as p from {held} where g is not null union all select artist_id, claim_id, 'Live', case when g is null then 0 else 1 end from {held} where live) group by 1, 2) group by 1"
register(
    "e14_artist_registry",
    lambda v: artists.artist_registry(_event_claims(v), ["label"])[0].select("artist_id", "name_key", "label", "stream_artist_id", F.array_join("genres", ",").alias("genres"), "claims", "events"),
    """select artist_id, min_by(name_key, claim_id) as name_key, min_by(label, claim_id) filter (trim(label) <> '') as label, min_by(stream_artist_id, claim_id) filter (stream_artist_id is not null) as stream_artist_id, coalesce(any_value(genres), '') as genres, count(distinct source_type || '|' || source_url || '|' || coalesce(feed_artist_id, '-')) as claims, count(distinct event_id) as events
from {held} left join {gs} using (artist_id) group by 1""",
    **_DEFINED, gs=_GENRES,
)
register("e14_artist_links", lambda v: artists.artist_registry(_event_claims(v), ["label"])[1], "select event_id, artist_id, role, min(claim_id) as first_claim from {held} group by 1, 2, 3", **_DEFINED)
