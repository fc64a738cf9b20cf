"""The library's tables derived from the driver's tables.

Each derived table is plain SQL that Spark and DuckDB read alike, so a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW_MS = 1_900_000_000_000
_B = "chr(92)"
_two = lambda x: f"lpad(cast({x} as varchar(8)), 2, '0')"
_Y, _M, _D = "cast(2005 + doc_id % 15 as varchar(8))", _two("1 + doc_id % 12"), _two("1 + doc_id % 31")
_H, _I, _S = _two("doc_id % 24"), _two("doc_id % 60"), _two("(doc_id * 7) % 60")
_EXT = "case lang when 'en' then 'jpg' when 'fr' then 'heic' when 'de' then 'mov' when 'es' then 'mp4' else 'txt' end"

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "files": (
        ("documents",),
        f"""select doc_id as id, source, 'D:' || {_B} || 'Media' || {_B} || source || {_B} || lang as dir_path,
            case doc_id % 7 when 0 then 'IMG_' || {_Y} || {_M} || {_D} || '_' || {_H} || {_I} || {_S}
                when 1 then 'Screenshot ' || {_Y} || '-' || {_M} || '-' || {_D} || ' ' || {_H} || '.' || {_I} || '.' || {_S}
                when 2 then 'FB_IMG_' || cast(1500000000000 + doc_id * 1000 as varchar(20)) when 3 then 'VID-' || {_Y} || {_M} || {_D} || '-WA0001'
                when 4 then 'DSC_' || cast(doc_id as varchar(20)) when 5 then 'ảnh Tết Đà Lạt ' || cast(doc_id as varchar(20))
                else 'Beach ' || {_Y} || '-' || {_M} || '-' || {_D} end || '.' || case when doc_id % 2 = 0 then {_EXT} else upper({_EXT}) end as name,
            {_EXT} as ext, case when lang in ('en', 'fr') then 0 else 1 end as kind, n_chars as size,
            case when doc_id % 13 = 0 then 'first ' || cast(doc_id as varchar(20)) || '.jpg' end as original_name,
            1500000000000 + doc_id * 86400000 as mtime, case when doc_id % 19 = 0 then 4096 else 32 end as attrs,
            case when doc_id % 17 = 0 then 1 when doc_id % 23 = 0 then 2 else 0 end as status,
            case when lang in ('de', 'es') and doc_id % 11 = 0 then doc_id - 1 end as live_pair_id, doc_id % 3 as seen_gen, text as content from documents""",
    ),
    "meta": (
        ("labels",),
        """select doc_id as file_id, cast(case when doc_id % 29 = 0 then null else 640 * (1 + doc_id % 5) end as bigint) as width, cast(480 * (1 + doc_id % 4) as bigint) as height,
            (doc_id % 900) * 1000 as duration_ms, case when doc_id % 6 = 0 then null else 1500000000000 + doc_id * 86400000 - (doc_id % 5) * 86400000 end as taken_at,
            cast(doc_id % 2 as int) as date_source, case doc_id % 3 when 0 then 'Canon' when 1 then 'NIKON CORPORATION' else null end as make,
            case doc_id % 4 when 0 then 'Canon EOS 5D' when 1 then ' D750/b' when 2 then '' else null end as model, cast(1 + doc_id % 8 as int) as orientation from labels""",
    ),
    "hashes": (
        ("documents",),
        """select doc_id as file_id, case when doc_id % 10 <> 3 then md5(substr(text, 1, 4096) || ':' || cast(n_chars as varchar(20))) end as quick,
            case when doc_id % 9 <> 0 and doc_id % 10 <> 3 then md5(text) end as full_hash,
            case when doc_id % 31 = 0 then n_chars + 1 else n_chars end as hashed_size, 1500000000000 + doc_id * 86400000 as hashed_mtime from documents""",
    ),
    "roots": (
        ("nation",),
        f"""select n_nationkey as id, 'D:' || {_B} || 'Media' || case when n_nationkey < 20 then {_B} || 'src' || cast(n_nationkey as varchar(4)) when n_nationkey = 20 then {_B} || 'src1' || {_B} || 'en'
            when n_nationkey = 21 then '' else {_B} || 'void' || cast(n_nationkey as varchar(4)) end as path, n_regionkey as volume_id from nation""",
    ),
    "marks": (("documents",), "select doc_id as file_id, doc_id % 5 = 0 or doc_id % 7 = 2 as marked from documents"),
    "disk": (("documents",), "select doc_id as file_id, case when doc_id % 41 <> 0 then case when doc_id % 37 = 0 then n_chars + 3 else n_chars end end as size, 1500000000000 + doc_id * 86400000 as mtime from documents"),
    "paths": (("events",), "select 'D:' || chr(92) || case when event_id % 3 = 0 then 'old' else 'new' end || chr(92) || cast(event_id as varchar(20)) as path, event_id % 500 as size, event_id % 7 as mtime, md5(cast(event_id % 500 as varchar(20)) || case when event_id % 5 = 2 then 'x' else '' end) as full_hash from events"),
    "expected": (("events",), "select file_id, min(file_id) as size, min(m) as mtime, case when min(file_id) % 3 <> 0 then md5(cast(min(file_id) as varchar(20))) end as full_hash from (select event_id % 500 as file_id, event_id % 7 as m from events) group by file_id"),
    "prints": (("embeddings",), "select vec_id as file_id, cast(label as bigint) as taken_at, embedding from embeddings"),
    "previous": (("documents",), "select doc_id as file_id, 100 + n_chars % 50 as group_id from documents"),
    "live": (
        ("conversations",),
        """select conv_id * 1000 + turn as id, 'D:' || chr(92) || 'c' || cast(conv_id as varchar(20)) as dir_path, 'IMG_' || cast(floor((turn + 1) / 2) as varchar(20)) || case role when 'user' then '.JPG' when 'assistant' then '.mov' else '.heic' end as name,
            case role when 'user' then 'jpg' when 'assistant' then 'mov' else 'heic' end as ext, case role when 'assistant' then 1 else 0 end as kind, 0 as status from conversations""",
    ),
    "ops": (
        ("events",),
        """select event_id as id, cast(floor(event_id / 25) as bigint) as batch_id, event_id % 500 as file_id, 'D:' || chr(92) || 'old' || chr(92) || cast(event_id as varchar(20)) as old_path,
            'D:' || chr(92) || 'new' || chr(92) || cast(event_id as varchar(20)) as new_path, case when event_id % 4 <> 0 then event_id * 10 end as done_at,
            case when event_id % 12 = 5 then event_id * 10 + 5 end as undone_at, case when event_id % 20 = 8 then event_id * 10 + 7 end as attempted_at from events""",
    ),
    "jobs": (("events",), "select event_id, user_id as job_id, event_type as state, value, cast(event_id % 97 as int) as done from events"),
    "photos": (("customer",), "select c_custkey as id, cast(case when c_custkey % 50 = 0 then 0.0 else ((c_custkey * 7919) % 1600000) / 10000.0 - 80.0 end as double) as lat, cast(case when c_custkey % 50 = 0 then 0.0 else ((c_custkey * 104729) % 3500000) / 10000.0 - 175.0 end as double) as lon from customer"),
    "cities": (("customer",), "select c_custkey as id, cast(((c_custkey * 7919 + 37 * (c_custkey % 11)) % 1600000) - 800000 as int) as lat_e4, cast(((c_custkey * 104729 + 41 * (c_custkey % 7)) % 3500000) - 1750000 as int) as lon_e4, c_name as name, cast(c_nationkey as int) as country, cast(case when c_custkey % 4 = 0 then -1 else c_custkey % 25 end as int) as admin1, cast(floor(abs(c_acctbal)) as int) as pop_k from customer"),
    "wards": (("supplier",), "select s_suppkey as id, cast(((s_suppkey * 7919) % 1600000) - 800000 + 211 as int) as lat_e4, cast(((s_suppkey * 104729) % 3500000) - 1750000 - 173 as int) as lon_e4, s_name as name, cast(case when s_suppkey % 3 = 0 then -1 else s_suppkey % 25 end as int) as district from supplier"),
    # trios of a live picture, its video and a single picture, in groups of equal content
    "shots": (
        ("customer",),
        f"""select c_custkey as id,
            case when (c_custkey - 1) % 3 = 1 and floor((c_custkey - 1) / 3) % 10 = 7 then 'F:' || {_B} || 'Clips' when floor((c_custkey - 1) / 3) % 3 = 0 then 'D:' || {_B} || 'Shots' || {_B} || 'a'
                when floor((c_custkey - 1) / 3) % 3 = 1 then 'D:' || {_B} || 'Shots' || {_B} || 'b' || {_B} || 'c' else 'E:' || {_B} || 'Roll' end as dir_path,
            case (c_custkey - 1) % 3 when 0 then 'IMG_' || cast(c_custkey as varchar(20)) || '.HEIC' when 1 then 'IMG_' || cast(c_custkey - 1 as varchar(20)) || '.MOV' else 'Photo ' || cast(c_custkey as varchar(20)) || '.jpg' end as name,
            case (c_custkey - 1) % 3 when 0 then 'heic' when 1 then 'mov' else 'jpg' end as ext, cast(case when (c_custkey - 1) % 3 = 1 then 1 else 0 end as int) as kind,
            cast(1000 + 10 * (floor((c_custkey - 1) / 3) % 40) + (c_custkey - 1) % 3 as bigint) as size, cast(1500000000000 + (floor((c_custkey - 1) / 3) % 40) * 86400000 as bigint) as mtime, 32 as attrs,
            cast(case when (c_custkey - 1) % 3 = 0 and (floor((c_custkey - 1) / 3) % 31 = 5 or floor((c_custkey - 1) / 3) % 40 = 9) then 1 when (c_custkey - 1) % 3 = 2 and floor((c_custkey - 1) / 3) % 29 = 3 then 2
                when (c_custkey - 1) % 3 = 1 and floor((c_custkey - 1) / 3) % 37 = 4 then 1 else 0 end as int) as status,
            cast(case when floor((c_custkey - 1) / 3) % 4 = 3 then null when (c_custkey - 1) % 3 = 0 then c_custkey + 1 when (c_custkey - 1) % 3 = 1 and floor((c_custkey - 1) / 3) % 20 <> 1 then c_custkey - 1 end as bigint) as live_pair_id,
            case when (c_custkey - 1) % 3 <> 1 and floor((c_custkey - 1) / 3) % 13 = 0 then 'First ' || cast(c_custkey as varchar(20)) || '.jpg' end as original_name, 1 as seen_gen from customer""",
    ),
    "shot_hashes": (
        ("customer",),
        """select c_custkey as file_id, md5('q' || cast(cast(floor((c_custkey - 1) / 3) % 40 as int) as varchar(20))) as quick,
            case when floor((c_custkey - 1) / 3) % 6 <> 2 then md5(cast(cast(floor((c_custkey - 1) / 3) % 40 as int) as varchar(20)) || ':' || cast((c_custkey - 1) % 3 as varchar(20)) || case when floor((c_custkey - 1) / 120) % 5 = 3 then 'x' else '' end) end as full_hash,
            cast(1000 + 10 * (floor((c_custkey - 1) / 3) % 40) + (c_custkey - 1) % 3 + case when floor((c_custkey - 1) / 3) % 23 = 0 then 1 else 0 end as bigint) as hashed_size,
            cast(1500000000000 + (floor((c_custkey - 1) / 3) % 40) * 86400000 as bigint) as hashed_mtime from customer""",
    ),
    "shot_meta": (
        ("customer",),
        """select c_custkey as file_id, cast(640 + c_custkey % 7 as bigint) as width, cast(480 as bigint) as height, cast(case when c_custkey % 9 = 0 then null else 1400000000000 + (floor((c_custkey - 1) / 3) % 40) * 3600000 end as bigint) as taken_at,
            0 as date_source, case c_custkey % 3 when 0 then 'Canon' else null end as make, case c_custkey % 4 when 0 then 'EOS 5D/b' else null end as model, cast(c_custkey * 10 as bigint) as duration_ms from customer""",
    ),
    "shot_groups": (("customer",), "select cast(1 + floor((c_custkey - 1) / 3) % 40 + 100 * ((c_custkey - 1) % 3) as bigint) as group_id, c_custkey as file_id from customer where (c_custkey - 1) % 3 <> 1"),
    "shot_marks": (("customer",), "select c_custkey as file_id, (c_custkey - 1) % 3 <> 1 and ((floor((c_custkey - 1) / 120) + floor((c_custkey - 1) / 3)) % 4 <> 0 or floor((c_custkey - 1) / 3) % 40 = 6) as marked from customer"),
    "shot_disk": (
        ("customer",),
        """select c_custkey as file_id, cast(1000 + 10 * (floor((c_custkey - 1) / 3) % 40) + (c_custkey - 1) % 3 + case when floor((c_custkey - 1) / 3) % 19 = 1 then 3 else 0 end as bigint) as size,
            cast(1500000000000 + (floor((c_custkey - 1) / 3) % 40) * 86400000 as bigint) as mtime from customer where floor((c_custkey - 1) / 3) % 41 <> 7""",
    ),
    "shot_later": (
        ("customer",),
        """select c_custkey as file_id, cast(1000 + 10 * (floor((c_custkey - 1) / 3) % 40) + (c_custkey - 1) % 3 + case when floor((c_custkey - 1) / 3) % 19 = 1 or c_custkey % 50 = 4 then 3 else 0 end as bigint) as size,
            cast(1500000000000 + (floor((c_custkey - 1) / 3) % 40) * 86400000 as bigint) as mtime from customer where floor((c_custkey - 1) / 3) % 41 <> 7""",
    ),
    "shot_fail": (("customer",), "select c_custkey as file_id, case c_custkey % 3 when 0 then 'TRASH_FAILED' when 1 then 'CANCELLED' else 'NO_RECYCLE_BIN' end as reason from customer where c_custkey % 11 = 3"),
    "thumbs": (("documents",), "select doc_id as file_id, n_chars as bytes, (doc_id * 7919) % 10007 as last_used from documents"),
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the driver's."""
    if name not in TABLES:
        return base(spark, sf_dir, name)
    needs, sql = TABLES[name]
    for n in needs:
        sql = sql.replace(f"from {n}", f"from {{{n}}}")
    return spark.sql(sql, **{n: base(spark, sf_dir, n) for n in needs})


def ctes(*names: str) -> str:
    """The derived tables as common table expressions."""
    return "with " + ", ".join(f"{n} as ({TABLES[n][1]})" for n in names)
