"""Queries of the functions over single values: names, paths, dates, media facts and texts for display."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import dates, media, text
from shelfspark.operators import index, places
from shelfspark.plans.registry import NOW, ZONE, _query
from shelfspark.sources import listing, transfer

_HOUR7 = 25_200_000


@_query("select id, case when dir_path like '%\\' then dir_path || name else dir_path || '\\' || name end as path, upper(left(dir_path, 1)) as drive, upper(left(dir_path, 1)) = 'D' as near from shots", ("shots",))
def paths_joined(t):
    p = text.join_path(F.col("dir_path"), F.col("name"))
    return t("shots").select("id", p.alias("path"), text.drive_letter(p).alias("drive"), text.same_volume(p, F.lit("d:\\x")).alias("near"))


@_query("""select event_id, case event_id % 4 when 0 then 'D:\\a\\b' when 1 then 'D:\\' when 2 then 'E:\\x' || event_id else 'rel\\y' end as path from events""")
def paths_normal(t):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, "d:/a/b/").when(i % 4 == 1, "d:/").when(i % 4 == 2, F.concat(F.lit("e:\\x"), i.cast("string"), F.lit("\\\\"))).otherwise("rel/y/")
    return t("events").select("event_id", text.normalize_path(raw).alias("path"))


@_query("""select event_id, case event_id % 5 when 0 then '_CON' when 1 then '_lpt3.txt' when 2 then 'a_b-c d' when 3 then 'x' || event_id else '' end as clean, case event_id % 5 when 0 then 'con' when 1 then 'lpt3.txt' when 2 then 'a__b--c  d' when 3 then '_-. x' || event_id || ' ._' else '...' end as raw from (select event_id from events) where event_id % 5 <> 0
    union all select event_id, '_con', 'con' from events where event_id % 5 = 0""")  # fmt: skip
def components_clean(t):
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, "con").when(i % 5 == 1, "lpt3.txt").when(i % 5 == 2, "a__b--c  d").when(i % 5 == 3, F.concat(F.lit("_-. x"), i.cast("string"), F.lit(" ._"))).otherwise("...")
    return t("events").select("event_id", text.clean_component(raw).alias("clean"), raw.alias("raw"))


@_query("""select event_id, case event_id % 4 when 0 then 'a\\b c' when 1 then 'x' when 2 then '' else 'tết\\n' || event_id end as rel from events""")
def relpaths_sanitized(t):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, "a/..\\b:| c").when(i % 4 == 1, "\\.\\ x?\\").when(i % 4 == 2, "..").otherwise(F.concat(F.lit("tết/*n"), i.cast("string")))
    return t("events").select("event_id", text.sanitize_relpath(raw).alias("rel"))


@_query("""select id, case ext when 'jpg' then 'image/jpeg' when 'mov' then 'video/mp4' when 'mp4' then 'video/mp4' else 'application/octet-stream' end as mime, ext as ext, case when strpos(name, '.') > 0 then regexp_replace(name, '[.][^.]*$', '') else name end as stem from files""", ("files",))
def mime_types(t):
    return t("files").select("id", text.mime(F.col("ext")).alias("mime"), text.extension(F.col("name")).alias("ext"), text.stem(F.col("name")).alias("stem"))


@_query("select event_id, mime from (select event_id, ['image/jpeg', 'image/x-icon', 'video/mpeg', 'video/mpeg', 'video/3gpp', 'video/mp4', 'video/mp4', 'application/octet-stream'][event_id % 8 + 1] as mime from events)")
def mime_rare(t):
    exts = F.array(*map(F.lit, ("jfif", "ico", "mpg", "mpeg", "3gp", "m4v", "mov", "heic")))
    return t("events").select("event_id", text.mime(F.element_at(exts, (F.col("event_id") % 8 + 1).cast("int"))).alias("mime"))


_FIRST, _MOST = 8 << 20, 16 << 20


@_query(f"""select event_id, case when ok then lo end as first, case when ok then hi end as last, ok from (select event_id, lo, hi, coalesce(lo <= hi and lo >= 0 and lo < n, false) as ok from (select event_id, n,
    case event_id % 6 when 0 then event_id when 1 then event_id when 2 then greatest(n - event_id, 0) when 3 then n when 4 then null else 5 end as lo,
    case event_id % 6 when 0 then least(event_id + {_FIRST} - 1, n - 1) when 1 then least(event_id * 100000, event_id + {_MOST} - 1, n - 1) when 2 then n - 1 when 3 then n - 1 when 4 then null else 4 end as hi
    from (select event_id, 20000000 + event_id as n from events where event_id % 6 <> 2 or event_id > 0)))""")  # fmt: skip
def byte_ranges(t):
    i, s = F.col("event_id"), F.col("event_id").cast("string")
    head = F.when(i % 6 == 0, F.concat(F.lit("bytes="), s, F.lit("-"))).when(i % 6 == 1, F.concat(F.lit("bytes="), s, F.lit("-"), (i * 100000).cast("string"))).when(i % 6 == 2, F.concat(F.lit("bytes=-"), s))
    head = head.when(i % 6 == 3, F.concat(F.lit("bytes="), (i + 20_000_000).cast("string"), F.lit("-"))).when(i % 6 == 4, "bytes=1-2,4-5").otherwise("bytes=5-4")
    r = text.byte_range(head, i + 20_000_000)
    return t("events").select("event_id", r.getField("start").alias("first"), r.getField("end").alias("last"), r.getField("ok").alias("ok"))


@_query("select event_id, case when event_id % 3 < 2 then 'ERR_X' || event_id % 7 end as code, case event_id % 3 when 0 then 'why' || event_id when 1 then '' else 'plain ' || event_id end as detail from events")
def error_codes(t):
    i, s = F.col("event_id"), F.col("event_id").cast("string")
    raw = F.when(i % 3 == 0, F.concat(F.lit("ERR_X"), (i % 7).cast("string"), F.lit("|why"), s)).when(i % 3 == 1, F.concat(F.lit("ERR_X"), (i % 7).cast("string"))).otherwise(F.concat(F.lit("plain "), s))
    code, detail = text.error_code(raw)
    return t("events").select("event_id", code.alias("code"), detail.alias("detail"))


@_query("""select file_id, case when s >= 3600 then s // 3600 || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') else s // 60 || ':' || lpad((s % 60)::varchar, 2, '0') end as shown
    from (select file_id, (duration_ms * 5 + 499) // 1000 as s from meta)""", ("meta",))  # fmt: skip
def duration_text(t):
    return t("meta").select("file_id", text.duration_text(F.floor((F.col("duration_ms") * 5 + 499) / 1000) * 1000).alias("shown"))


@_query(f"select id, strftime(make_timestamp((mtime + {_HOUR7}) * 1000), '%Y-%m-%d') as day, strftime(make_timestamp((mtime + {_HOUR7}) * 1000), '%Y-%m-%d %H:%M') as minute, '-' as none, {_HOUR7 // 60000} as minutes from files", ("files",))
def date_texts(t):
    m = F.col("mtime")
    none = dates.date_time_text(F.lit(None).cast("long"))
    return t("files").select("id", dates.date_input(m, ZONE).alias("day"), dates.date_time_text(m, ZONE).alias("minute"), none.alias("none"), (dates.offset_ms(m, ZONE) / 60000).cast("int").alias("minutes"))


@_query("select event_id, case when epoch_ms(ts) between 1711868400000 and 1729994400000 - 1 or (epoch_ms(ts) >= 1711846800000 + 21600000 and epoch_ms(ts) < 1729994400000) then 120 else 60 end as minutes from events")
def zone_with_summer_time(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t("events").select("event_id", (dates.offset_ms(ms, "Europe/Berlin") / 60000).cast("int").alias("minutes"))


@_query(f"select d::varchar as day, epoch_ms(d::timestamp) - {_HOUR7} as first, epoch_ms(d::timestamp) - {_HOUR7} + 86399999 as last from (select distinct ts::date as d from events)")
def day_bounds(t):
    """Bounds of the days of a filter form; the days are few, and bounds are computed for each of them on the driver."""
    days = [r[0] for r in t("events").select(F.date_format("ts", "yyyy-MM-dd").alias("d")).distinct().orderBy("d").limit(1000).collect()]
    rows = [(d, dates.day_bound(d, ZONE), dates.day_bound(d, ZONE, end=True)) for d in days]
    return t("events").sparkSession.createDataFrame(rows, "day string, first long, last long")


_EXIF = "epoch_ms(make_timestamp(2000 + event_id % 20, 1 + event_id % 12, 1 + event_id % 28, event_id % 24, event_id % 60, 0::double)) + (event_id % 61) * 1000"


@_query(f"select event_id, case event_id % 7 when 0 then null when 1 then {_EXIF} + 120 else {_EXIF} end as ms from events")
def exif_times(t):
    i = F.col("event_id")
    shown = F.format_string("%04d:%02d:%02d %02d:%02d:%02d", 2000 + i % 20, 1 + i % 12, 1 + i % 28, i % 24, i % 60, i % 61)
    bad = F.format_string("1989:%02d:31 00:00:00", 1 + i % 12)
    return t("events").select("event_id", dates.exif_ms(F.when(i % 7 == 0, bad).otherwise(shown), F.when(i % 7 == 1, "12"), F.lit(NOW)).alias("ms"))


@_query(f"""select event_id, case event_id % 4 when 0 then ms when 1 then ms + {_HOUR7} when 2 then ms + {_HOUR7} else null end as taken from (select event_id, epoch_ms(date_trunc('second', ts)) as ms from events)""")
def video_times(t):
    """An offset means local time already, Z and none mean UTC; the second time counts where the first is unreadable."""
    i = F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    first = F.when(i % 4 == 0, F.concat(iso, F.lit("+0700"))).when(i % 4 == 1, F.concat(iso, F.lit(".000Z"))).otherwise("not a time")
    second = F.when(i % 4 == 2, F.concat(iso, F.lit(".000000Z"))).when(i % 4 == 3, "1970-01-01T00:00:00Z")
    return t("events").select("event_id", dates.video_taken(first, second, F.lit(NOW), ZONE).alias("taken"))


@_query("""select p_partkey as id, greatest(1, floor(w * s + 0.5))::int as width, greatest(1, floor(h * s + 0.5))::int as height, least(greatest(p_size * 1000 * 0.1 / 1000, 1.0), 30.0)::double as seek from
    (select *, least(1.0::double, 256.0::double / greatest(w, h)) as s from (select p_partkey, p_size, (p_size * 37)::int as w, (1 + p_partkey % 900)::int as h from part))""")  # fmt: skip
def thumb_sizes(t):
    w, h = (F.col("p_size") * 37).cast("int"), (1 + F.col("p_partkey") % 900).cast("int")
    a, b = media.fit(w, h, 256)
    return t("part").select(F.col("p_partkey").alias("id"), a.alias("width"), b.alias("height"), media.seek_seconds(F.col("p_size") * 1000).cast("double").alias("seek"))


@_query("select id, list_extract(string_split(dir_path, '\\'), -1) as folder from files", ("files",))
def folder_names(t):
    return t("files").select("id", text.last_segment(F.concat("dir_path", F.lit("\\"))).alias("folder"))


@_query("select event_id from events where event_id % 6 not in (0, 1, 3)")
def folders_scanned(t):
    """Folders of the system, and those that the user left out, are not scanned, whatever their case; names that only begin alike are."""
    i, s = F.col("event_id"), F.col("event_id").cast("string")
    folder = F.when(i % 6 == 0, F.concat(F.lit("D:\\$Recycle.BIN\\"), s)).when(i % 6 == 1, F.concat(F.lit("D:\\a\\node_modules\\"), s)).when(i % 6 == 2, F.concat(F.lit("D:\\windows2\\"), s))
    folder = folder.when(i % 6 == 3, F.concat(F.lit("d:\\Private\\"), s)).when(i % 6 == 4, F.concat(F.lit("D:\\PrivateNot\\"), s)).otherwise(F.concat(F.lit("D:\\b\\"), s))
    return t("events").where(index.not_excluded(folder, ["D:\\private\\"])).select("event_id")


@_query("select count(*) filter (where event_id % 5 not in (3, 4)) as indexed, count(*) filter (where event_id % 5 = 1) as cloud, count(*) filter (where event_id % 5 = 2) as videos, count(*) filter (where event_id % 5 = 4) as lossy from events")
def scan_classes(t):
    """Names without an extension of media are left out, those that are no text are counted."""
    i, s = F.col("event_id"), F.col("event_id").cast("string")
    name = F.when(i % 5 == 0, F.concat(s, F.lit(".DNG"))).when(i % 5 == 1, F.concat(s, F.lit(".jxl"))).when(i % 5 == 2, F.concat(s, F.lit(".M2TS"))).when(i % 5 == 3, s).otherwise(F.concat(s, F.lit("\ufffd.jpg")))
    raw = t("events").select(F.lit("D:\\x").alias("dir_path"), name.alias("name"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), F.when(i % 5 == 1, 0x400000).otherwise(32).alias("attrs"))
    good = listing.readable_names(raw)
    lossy = raw.agg(F.count_if(F.col("name").contains("\ufffd")).alias("lossy"))
    return index.scan_summary(index.classify(good)).drop("errors").crossJoin(F.broadcast(lossy))


@_query("select event_id from events where event_id % 4 in (0, 3)")
def transport_streams(t):
    """Of files named .ts only those with both sync bytes are videos; others are kept whatever they hold; a cloud one can't be read and goes."""
    i = F.col("event_id")
    sync, other = F.lit(bytes([0x47]) + bytes(187) + bytes([0x47])), F.lit(bytes(300))
    d = t("events").select("event_id", F.when(i % 4 < 3, "a.TS").otherwise("a.tsx").alias("name"), F.when(i % 4 == 0, sync).when(i % 4 == 1, other).when(i % 4 == 3, other).alias("content"))
    return listing.drop_source_code(d).select("event_id")


@_query("""select p_partkey as id, case when p_size % 5 > 0 then [list_sum([case when ((w * 64 + k) // 16 * 17 + (w * 64 + k) % 16) * p_size % 97 > ((w * 64 + k) // 16 * 17 + (w * 64 + k) % 16 + 1) * p_size % 97
    then (case when k = 0 then -9223372036854775808::hugeint else (1::hugeint << (63 - k)::int) end) else 0 end for k in range(0, 64)])::bigint for w in range(0, 4)] end as hash from part""")  # fmt: skip
def gradient_fingerprints(t):
    """Fingerprints of made-up grids of 17 by 16; flat ones have none."""
    g = F.transform(F.sequence(F.lit(0), F.lit(17 * 16 - 1)), lambda k: F.when(F.col("p_size") % 5 > 0, k * F.col("p_size") % 97).otherwise(F.lit(50)))
    return t("part").select(F.col("p_partkey").alias("id"), media.difference_hash(g).alias("hash"))


@_query("select n_nationkey as id, case n_nationkey % 3 when 0 then 'Manual ' || n_name when 1 then n_name else n_name || ' Land' end as shown from nation")
def place_names(t):
    i, n = F.col("n_nationkey"), F.col("n_name")
    manual, local = F.when(i % 3 == 0, F.concat(F.lit("Manual  "), n)), F.when(i % 3 == 1, F.concat(F.lit(" "), n))
    return t("nation").select(i.alias("id"), places.local_name(manual, local, F.concat(n, F.lit(" Land Province"))).alias("shown"))


@_query("""select 'city' as kind, cast(round(c_custkey * 0.01 * 10000) as int) as lat_e4, case when c_custkey % 3 = 0 then 'Local ' || c_custkey else 'Café ' || c_custkey end as name, c_nationkey as country, case when c_custkey % 5 = 0 then -1 else c_nationkey end as parent, cast(floor(c_custkey * 123 / 1000) as int) as pop_k from customer
    union all select 'ward', cast(round(c_custkey * 0.01 * 10000) as int), 'Ward ' || c_custkey, null, case when c_custkey % 2 = 0 then 0 else -1 end, null from customer where c_custkey % 50 = 1 or c_custkey % 50 = 2
    union all select 'admin1', null, case when n_nationkey = 4 then 'By Hand' else 'Land ' || n_nationkey end, null, n_nationkey, null from nation
    union all select 'country', null, n_name, null, n_nationkey, null from nation union all select 'district', null, 'District', null, 0, null""")  # fmt: skip
def places_built(t):
    """A place file from raw tables: local and manual names, suffixes, decomposed letters, unknown provinces and districts."""
    n, k = t("nation"), F.col("c_custkey")
    code = lambda c: F.format_string("c%02d", c)
    c = t("customer")
    countries = n.select(code("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    admin1 = n.select(F.concat(code("n_nationkey"), F.lit(".A")).alias("code"), F.format_string("Land  %d Province", "n_nationkey").alias("name"), (F.col("n_nationkey") + 10_000_000).cast("long").alias("geo_id"))
    cities = c.select(k.alias("geo_id"), F.format_string("Cafe\u0301 %d", k).alias("name"), (k * 0.01).cast("string").alias("lat"), F.lit("1.5").alias("lon"), code("c_nationkey").alias("country"), F.when(k % 5 == 0, "none").otherwise("A").alias("admin1"), (k * 123).cast("string").alias("population"))
    fine = c.where("c_custkey % 50 in (1, 2)").select(k.alias("geo_id"), F.lit("ADM3").alias("level"), F.format_string("Ward %d", k).alias("name"), (k * 0.01).cast("string").alias("lat"), F.lit("1.5").alias("lon"), F.lit("c00").alias("country"), F.lit("A").alias("admin1"), F.when(k % 2 == 0, "D").otherwise("E").alias("admin2"))
    fine = fine.unionByName(t("region").where("r_regionkey = 0").select(F.lit(1).cast("long").alias("geo_id"), F.lit("ADM2").alias("level"), F.lit(" District ").alias("name"), F.lit(None).cast("string").alias("lat"), F.lit(None).cast("string").alias("lon"), F.lit("c00").alias("country"), F.lit("A").alias("admin1"), F.lit("D").alias("admin2")))
    alt = c.where("c_custkey % 3 = 0").select(k.alias("geo_id"), code("c_nationkey").alias("country"), F.lit("xx").alias("lang"), F.format_string("Local  %d", k).alias("name"), F.lit(True).alias("preferred"))
    alt = alt.unionByName(alt.withColumn("name", F.lit("A worse one")).withColumn("preferred", F.lit(None).cast("boolean")))
    manual = n.where("n_nationkey = 4").select(F.concat(code("n_nationkey"), F.lit(".A")).alias("code"), F.lit("By Hand").alias("name"))
    p = places.build_places(countries, admin1, cities, fine, alt, manual, {f"c{i:02d}": "xx" for i in range(25)})
    none = F.lit(None).cast("int")
    out = p["cities"].select(F.lit("city").alias("kind"), "lat_e4", "name", "country", F.col("admin1").alias("parent"), "pop_k")
    out = out.unionByName(p["fine"].select(F.lit("ward").alias("kind"), "lat_e4", "name", none.alias("country"), F.col("district").alias("parent"), none.alias("pop_k")))
    for kind, d in (("admin1", p["admin1"]), ("country", p["countries"]), ("district", p["districts"])):
        out = out.unionByName(d.select(F.lit(kind).alias("kind"), none.alias("lat_e4"), "name", none.alias("country"), F.col("index").alias("parent"), none.alias("pop_k")))
    return out


@_query("select r_name as key, case when r_regionkey = 2 then '[\"D:\\\\x\",\"E:\\\\y\"]' else 'v' || r_regionkey end as value from region union all select 'scan_gen', '7' from (select 1)")
def settings_set(t):
    kv = t("region").select(F.col("r_name").alias("key"), F.concat(F.lit("v"), F.col("r_regionkey").cast("string")).alias("value"))
    key = t("region").where("r_regionkey = 2").first()["r_name"]
    return transfer.with_setting(transfer.with_setting(kv, key, ["D:\\x", "E:\\y"]), "scan_gen", 7)


@_query(None)
def geo_full(t):
    """Places with province and ward names looked up by index; -1 has none."""
    names = t("nation").select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("name"))
    return places.named(places.lookup(t("photos"), t("cities"), t("wards")), names, names, names).select("photo_id", "city", "province", "country_name", "ward", "district_name")


from shelfspark.plans import registry as _r  # noqa: E402

_geo = _r._SQL["geo_city"]
_tail = _geo[_geo.index(", k as (") :]
_near = _tail[: _tail.index("select n.photo_id")]
_r._SQL["geo_full"] = _r.catalog.ctes("photos", "cities", "wards") + _near + f""", ct as (select n.photo_id, b.id as city_id, b.name as city, coalesce(b.country, n.country) as country from near n left join best b on b.photo_id = n.photo_id and b.rn = 1 where n.rn = 1),
    kw as (select p.id as photo_id, c.id, c.name, c.district, c.lat_e4, {_r._KM} as km from photos p join wards c on abs(c.lat_e4 / 10000.0 - p.lat) < 0.1 where {_r._GOOD}),
    wd as (select photo_id, name as ward, district from (select *, row_number() over (partition by photo_id order by km, lat_e4, id) as rn from kw where km <= 10) where rn = 1)
    select p.id as photo_id, ct.city, a.n_name as province, co.n_name as country_name, wd.ward, di.n_name as district_name from photos p left join ct on ct.photo_id = p.id left join wd on wd.photo_id = p.id
    left join cities cc on cc.id = ct.city_id left join nation a on a.n_nationkey = cc.admin1 left join nation co on co.n_nationkey = ct.country left join nation di on di.n_nationkey = wd.district"""  # fmt: skip
