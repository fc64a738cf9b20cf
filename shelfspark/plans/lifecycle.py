"""Queries about what changes: roots, scans, stored groups and deletions, fingerprints, libraries, the journal and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import templates, text
from shelfspark.operators import dedup, index, journal, organize, search, similar
from shelfspark.operators.search import FileFilter
from shelfspark.plans.registry import _COMP, _SHOWN, _WIDE, LIBRARY, NOW, ROOT, ZONE, _query, _similar, _wide_items
from shelfspark.plans.registry import _SQL as SQL
from shelfspark.session import stored
from shelfspark.sources import catalog

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_PATH = "dir_path || chr(92) || name"


def _sql(name: str, tables: tuple[str, ...], body: str) -> None:
    SQL[name] = catalog.ctes(*tables) + body


# ---- roots and scans


@_query("select id, path, row_number() over (order by path) as pos from roots", ("roots",))
def roots_by_path(t):
    from shelfspark.operators.rank import ranked

    return ranked(index.list_roots(t("roots")).select("id", "path"), "path", name="pos")


@_query("select id, path from roots where id = 7", ("roots",))
def root_by_id(t):
    return index.get_root(t("roots"), 7).select("id", "path")


@_query("select max(id) + 1 as id, 'D:\\Media' as path from roots union all select 99, 'E:\\Other' from (select 1)", ("roots",))
def root_absorbs(t):
    """A new root takes in those under it; its number follows the highest there was."""
    r = t("roots").where("id <> 21").select("id", "path")
    other = r.sparkSession.range(1).select(F.lit(99).cast("int").alias("id"), F.lit("E:\\Other").alias("path"))
    roots, _ = index.add_root(r, "d:/Media/")
    return roots.where("path <> 'E:\\\\Other'").select("id", "path").unionByName(other)


@_query("select id, path from roots", ("roots",))
def root_covered(t):
    """Under another root nothing is added."""
    roots, error = index.add_root(t("roots").select("id", "path"), "d:/media/SRC1/en/deep")
    assert error.startswith("ERR_ROOT_COVERED|")
    return roots


@_query("""select f.id from files f, (select upper(path) as p from roots where id = 3) r where not (upper(f.dir_path) = r.p or starts_with(upper(f.dir_path), r.p || '\\'))""", ("files", "roots"))
def root_removed(t):
    return index.remove_root(t("roots"), t("files"), 3)[1].select("id")


@_query("select id from roots where id not in (select a.id from roots a join roots b on upper(a.path) <> upper(b.path) and starts_with(upper(a.path), upper(rtrim(b.path, '\\')) || '\\'))", ("roots",))
def roots_not_covered(t):
    return index.covering_roots(t("roots")).select("id")


@_query("""select k as key from (select distinct upper(p) as k from (select dir_path as p from files union all select path from roots)) a
    where not exists (select 1 from (select distinct upper(p) as q from (select dir_path as p from files union all select path from roots)) b where q <> k and starts_with(k, rtrim(q, '\\') || '\\'))""", ("files", "roots"))  # fmt: skip
def scopes_minimal(t):
    return index.minimal_scopes(t("files").select(F.col("dir_path").alias("path")).unionByName(t("roots").select("path")))


@_query("select id, status, false as newly_missing from files", ("files",))
def reconcile_refused(t):
    return index.reconcile_guarded(t("files"), ROOT, 2, [f"D:\\Media\\x{i}" for i in range(index.MOST_SCOPES + 1)]).select("id", "status", "newly_missing")


@_query("select m.file_id from meta m join files f on f.id = m.file_id where not (f.id % 4 = 0)", ("files", "meta"))
def meta_after_merge(t):
    """Metadata that is still of the file after a scan in which every fourth had grown."""
    f = t("files").withColumn("name", F.concat(F.col("id").cast("string"), F.lit("_"), F.col("name")))
    scan = f.select("dir_path", "name", F.when(F.col("id") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime", "attrs", "status")
    return index.stale_rows(t("meta"), index.merge_scan(f, scan, 5)).select("file_id")


@_query("select file_id from meta where file_id not in (select id from files where kind = 1)", ("files", "meta"))
def meta_after_zone(t):
    return index.zone_changed(t("meta"), t("files")).select("file_id")


_THUMBS = "select file_id, 256 as s, last_used as src_mtime, bytes, last_used * 3 as last_used from thumbs"


def _thumbs(t):
    return t("thumbs").select("file_id", F.lit(256).alias("s"), F.col("last_used").alias("src_mtime"), "bytes", (F.col("last_used") * 3).alias("last_used"))


@_query(f"select file_id, bytes, case when file_id % 3 = 0 and src_mtime % 2 = 0 and 20000 - last_used > 3600 then 20000 else last_used end as last_used from ({_THUMBS})", ("thumbs",))
def thumbs_touched(t):
    w = _thumbs(t).where("file_id % 3 = 0").select("file_id", "s", F.when(F.col("src_mtime") % 2 == 0, F.col("src_mtime")).otherwise(-1).alias("src_mtime"))
    return index.thumb_get(_thumbs(t), w, 20_000)[1].select("file_id", "bytes", "last_used")


@_query(f"select file_id from ({_THUMBS}) where file_id % 3 = 0 and src_mtime % 2 = 0", ("thumbs",))
def thumbs_hit(t):
    w = _thumbs(t).where("file_id % 3 = 0").select("file_id", "s", F.when(F.col("src_mtime") % 2 == 0, F.col("src_mtime")).otherwise(-1).alias("src_mtime"))
    return index.thumb_get(_thumbs(t), w, 20_000)[0].select("file_id")


@_query(f"select file_id, case when file_id % 4 = 0 then bytes + 1 else bytes end as bytes from ({_THUMBS})", ("thumbs",))
def thumbs_put(t):
    new = _thumbs(t).where("file_id % 4 = 0").withColumn("bytes", F.col("bytes") + 1)
    return index.thumb_put(_thumbs(t), new).select("file_id", "bytes")


@_query("select 4 as gen from (select 1)", ())
def generation_next(t):
    from shelfspark.sources import transfer

    kv = t("nation").limit(0).select(F.col("n_name").alias("key"), F.col("n_name").alias("value"))
    return transfer.next_generation(transfer.with_setting(kv, "scan_gen", 3)).select(F.col("gen").cast("int").alias("gen"))


@_query("""select count(*) filter (where ext in ('jpg', 'heic', 'mov', 'mp4')) as indexed, count(*) filter (where ext in ('jpg', 'heic', 'mov', 'mp4') and attrs & 4096 <> 0) as cloud, count(*) filter (where ext in ('mov', 'mp4')) as videos,
    count(*) filter (where status in (0, 2) and seen_gen < 2) as missing, 0 as lossy from files""", ("files",))  # fmt: skip
def scan_report(t):
    raw = t("files").select("dir_path", "name", "size", "mtime", "attrs")
    return index.scan_report(raw, index.classify(raw), index.reconcile(t("files"), ROOT, 2))


# ---- stored groups and deletions

_SHOT = ("shots", "shot_hashes", "shot_groups", "shot_marks", "shot_disk")
_CTX = f""", c as (select m.group_id, f.id as file_id, {_PATH} as path, f.kind, f.size, f.mtime, f.status, f.live_pair_id, h.full_hash, h.hashed_size, h.hashed_mtime from shot_groups m join shots f on f.id = m.file_id left join shot_hashes h on h.file_id = f.id),
    j as (select c.*, k.marked as del, coalesce(d.size = c.size and d.mtime = c.mtime, false) as on_disk, coalesce(c.hashed_size = c.size and c.hashed_mtime = c.mtime and c.full_hash is not null, false) as fresh
        from c join shot_marks k using (file_id) left join shot_disk d using (file_id)),
    g as (select group_id, count(*) filter (where not del) as keepers, arg_min(full_hash, file_id) filter (where not del and status = 0 and on_disk and fresh) as sv_hash, min(file_id) filter (where not del and status = 0 and on_disk and fresh) as sv from j group by group_id),
    plan as (select j.group_id, j.file_id, g.sv as survivor_id, case when keepers = 0 then 'KEEP_NONE' when sv is null then 'NO_VERIFIED_SURVIVOR' when status <> 0 then 'NOT_PRESENT' when not fresh or full_hash <> sv_hash then 'HASH_MISMATCH'
        when not on_disk then 'CHANGED_ON_DISK' else 'OK' end as reason from j join g using (group_id) where del) """  # fmt: skip
_PAIRS = """, vid as (select f.id, h.full_hash from shots f join shot_hashes h on h.file_id = f.id join shot_disk d on d.file_id = f.id and d.size = f.size and d.mtime = f.mtime
        where f.kind = 1 and f.status = 0 and f.size > 0 and h.hashed_size = f.size and h.hashed_mtime = f.mtime and h.full_hash is not null),
    pp as (select a.live_pair_id as pair_id, p.group_id, p.file_id, b.live_pair_id as kept_pair_id, row_number() over (partition by a.live_pair_id order by p.group_id, p.file_id) as rn from plan p join shots a on a.id = p.file_id and a.kind = 0
        join shots b on b.id = p.survivor_id join vid v1 on v1.id = a.live_pair_id join vid v2 on v2.id = b.live_pair_id where p.reason = 'OK' and v1.full_hash = v2.full_hash and v1.id <> v2.id),
    pairs as (select file_id, pair_id, kept_pair_id from pp where rn = 1) """


def _context(t):
    return dedup.with_context(t("shot_groups"), t("shots"), t("shot_hashes"))


def _shot_plan(t):
    return dedup.delete_plan(_context(t), t("shot_marks").where("marked"), t("shot_disk"))


def _shot_pairs(t):
    plan = stored(_shot_plan(t))
    keepers = _context(t).select("file_id").join(plan.where("reason = 'OK'").select("file_id"), "file_id", "left_anti")
    return plan, dedup.pair_plan(plan, t("shots"), t("shot_hashes"), t("shot_disk"), keepers)


@_query(f"select m.group_id, f.id as file_id, {_PATH} as path, f.size, f.mtime, f.status, k.width, k.height, k.taken_at from shot_groups m join shots f on f.id = m.file_id left join shot_meta k on k.file_id = f.id", ("shots", "shot_groups", "shot_meta"))
def group_members(t):
    return dedup.group_rows(t("shot_groups"), t("shots"), t("shot_meta"))


@_query(None)
def group_context(t):
    return dedup.delete_context(_context(t), t("shot_marks").where("marked and file_id % 7 = 0"))


_sql("group_context", _SHOT, _CTX + "select * from c where group_id in (select group_id from shot_groups join shot_marks using (file_id) where marked and file_id % 7 = 0)")


@_query(None)
def single_context(t):
    return dedup.file_context(t("shots"), t("shot_hashes"), t("shot_marks").where("marked")).select("group_id", "file_id", "path", "kind", "live_pair_id", "full_hash")


_sql("single_context", _SHOT, f" select 0 as group_id, f.id as file_id, {_PATH} as path, f.kind, f.live_pair_id, h.full_hash from shots f join shot_marks k on k.file_id = f.id and k.marked left join shot_hashes h on h.file_id = f.id")


@_query("select live_pair_id as pair_id, id as image_id from shots where kind = 0 and live_pair_id is not null", ("shots",))
def pair_refs(t):
    return dedup.image_refs(t("shots"), t("shots").where("kind = 1").select(F.col("id").alias("pair_id")))


@_query(None)
def delete_plan_stored(t):
    return _shot_plan(t)


_sql("delete_plan_stored", _SHOT, _CTX + "select * from plan")


@_query(None)
def delete_reasons(t):
    return dedup.histogram(_shot_plan(t))


_sql("delete_reasons", _SHOT, _CTX + "select reason, count(*) as n from plan group by reason")


@_query(None)
def pair_plan(t):
    return _shot_pairs(t)[1]


_sql("pair_plan", _SHOT, _CTX + _PAIRS + "select * from pairs")


@_query(None)
def pairs_trashed(t):
    """Videos that go after all images but every third have gone."""
    plan, pairs = _shot_pairs(t)
    gone = plan.where("reason = 'OK' and file_id % 9 <> 1").select("file_id")
    return dedup.pairs_to_trash(pairs, dedup.image_refs(t("shots"), pairs.select("pair_id")), gone)


_sql("pairs_trashed", _SHOT, _CTX + _PAIRS + """select * from pairs p where p.file_id in (select file_id from plan where reason = 'OK' and file_id % 9 <> 1)
    and not exists (select 1 from shots i where i.kind = 0 and i.live_pair_id = p.pair_id and i.id not in (select file_id from plan where reason = 'OK' and file_id % 9 <> 1))""")  # fmt: skip


@_query(None)
def delete_outcome(t):
    return dedup.delete_result(t("shots").select(F.col("id").alias("file_id")).where("file_id % 2 = 0"), _shot_plan(t), t("shot_later"), t("shots"), t("shot_fail"))


_sql("delete_outcome", (*_SHOT, "shot_later", "shot_fail"), _CTX + """, now as (select f.id from shots f join shot_later d on d.file_id = f.id and d.size = f.size and d.mtime = f.mtime),
    r as (select f.id as file_id, f.size, case when p.reason is null then 'NOT_IN_GROUP' when p.reason <> 'OK' then p.reason when p.survivor_id not in (select id from now) then 'SURVIVOR_CHANGED' when x.reason = 'CANCELLED' then 'CANCELLED'
        when f.id not in (select id from now) then 'CHANGED_ON_DISK' when x.reason is not null then x.reason else 'DELETED' end as reason from shots f left join plan p on p.file_id = f.id left join shot_fail x on x.file_id = f.id where f.id % 2 = 0)
    select file_id, reason, case when reason = 'DELETED' then size else 0 end as freed from r""")  # fmt: skip


@_query(None)
def similar_delete_plan(t):
    """Over the groups of similar pictures: no hashes, every seventh missing, every fifth changed on disk, even ones and all of every third group's marked."""
    _, m = _similar(t)
    context = m.select("group_id", "file_id", (F.col("file_id") * 10 + 1).alias("size"), F.lit(5).cast("long").alias("mtime"), F.when(F.col("file_id") % 7 == 0, 1).otherwise(0).alias("status"))
    context = stored(context)
    disk = context.select("file_id", F.when(F.col("file_id") % 5 == 0, 0).otherwise(F.col("size")).alias("size"), "mtime").distinct()
    return dedup.delete_plan(context, context.where("file_id % 2 = 0 or group_id % 3 = 0").select("file_id").distinct(), disk, check_hash=False)


_sql("similar_delete_plan", ("prints",), _COMP + """, j as (select group_id, file_id, file_id % 2 = 0 or group_id % 3 = 0 as del, case when file_id % 7 = 0 then 1 else 0 end as status, file_id % 5 <> 0 as on_disk from mem),
    g as (select group_id, count(*) filter (where not del) as keepers, min(file_id) filter (where not del and status = 0 and on_disk) as sv from j group by group_id)
    select j.group_id, j.file_id, sv as survivor_id, case when keepers = 0 then 'KEEP_NONE' when sv is null then 'NO_VERIFIED_SURVIVOR' when status <> 0 then 'NOT_PRESENT' when not on_disk then 'CHANGED_ON_DISK' else 'OK' end as reason from j join g using (group_id) where del""")  # fmt: skip


@_query("""select file_id, case when fresh then coalesce(nq, quick) else quick end as quick, case when not fresh then full_hash when hashed_size = size and hashed_mtime = mtime then coalesce(nf, full_hash) else nf end as full_hash,
    case when fresh then size else hashed_size end as hashed_size, case when fresh then mtime else hashed_mtime end as hashed_mtime from (
    select h.*, f.size, f.mtime, coalesce(d.size = f.size and d.mtime = f.mtime and h.file_id % 2 = 0, false) as fresh, case when h.file_id % 3 = 0 then 'new' end as nq, case when h.file_id % 4 = 0 then 'full' end as nf
    from shot_hashes h join shots f on f.id = h.file_id left join shot_disk d on d.file_id = h.file_id)""", ("shots", "shot_hashes", "shot_disk"))  # fmt: skip
def hashes_upserted(t):
    i = F.col("file_id")
    new = t("shot_disk").where("file_id % 2 = 0").select("file_id", F.when(i % 3 == 0, "new").alias("quick"), F.when(i % 4 == 0, "full").alias("full_hash"), F.col("size").alias("src_size"), F.col("mtime").alias("src_mtime"))
    return dedup.upsert_hashes(t("shots"), t("shot_hashes"), new)


@_query("select min(f.id) over (partition by md5(content)) as group_id, f.id as file_id from files f where status = 0 and size > 0 qualify count(*) over (partition by md5(content)) >= 2", ("files",))
def dedup_phases(t):
    """From no hash at all: quick hashes of what shares its size, full hashes of what shares both, groups."""
    f = t("files")
    text_of = f.select("id", "content", "mtime")

    def read(quick: bool):
        def run(candidates):
            d = candidates.join(text_of, "id")
            q, h = F.md5(F.substring("content", 1, 4096)), F.md5("content")
            return d.select(F.col("id").alias("file_id"), (q if quick else F.lit(None).cast("string")).alias("quick"), (F.lit(None).cast("string") if quick else h).alias("full_hash"), F.col("size").alias("src_size"), F.col("mtime").alias("src_mtime"))

        return run

    return dedup.dedup_job(f, t("hashes").limit(0), read(True), read(False))[1].select("group_id", "file_id")


# ---- fingerprints

_OLD = "select id as file_id, 0 as kind, s as seq, id * 10 + s as hash64 from shots, (select unnest([0, 1, 2, 3]) as s) where id % 2 = 0 union all select id, 5, 0, 1 from shots where id % 10 = 0 union all select id, 3, 0, 0 from shots where id % 22 = 1"


def _phashes(t):
    f = t("shots").select(F.col("id").cast("long").alias("file_id"))
    words = f.where("file_id % 2 = 0").select("file_id", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq")).withColumn("hash64", F.col("file_id") * 10 + F.col("seq"))
    other = f.where("file_id % 10 = 0").select("file_id", F.lit(5).alias("kind"), F.lit(0).alias("seq"), F.lit(1).cast("long").alias("hash64"))
    none = f.where("file_id % 22 = 1").select("file_id", F.lit(3).alias("kind"), F.lit(0).alias("seq"), F.lit(0).cast("long").alias("hash64"))
    return words.unionByName(other).unionByName(none)


@_query(f"""with recursive x(y) as (select 1), old as ({_OLD}), fresh as (select d.file_id from shot_disk d join shots f on f.id = d.file_id and f.size = d.size and f.mtime = d.mtime where d.file_id % 3 = 0)
    select * from old where kind not in (0, 3) or file_id not in (select file_id from fresh)
    union all select file_id, 0, s, file_id + s from fresh, (select unnest([0, 1, 2, 3]) as s) where file_id % 9 <> 0 union all select file_id, 3, 0, 0 from fresh where file_id % 9 = 0""")  # fmt: skip
def fingerprints_upserted(t):
    i = F.col("file_id")
    new = t("shot_disk").where("file_id % 3 = 0").select("file_id", F.when(i % 9 != 0, F.array(i, i + 1, i + 2, i + 3)).alias("hash"), F.col("size").alias("src_size"), F.col("mtime").alias("src_mtime"))
    return similar.upsert_fingerprints(t("shots"), _phashes(t), new)


SQL["fingerprints_upserted"] = SQL["fingerprints_upserted"].replace("with recursive x(y) as (select 1),", catalog.ctes("shots", "shot_disk") + ",")


@_query("select id from shots where kind = 0 and status = 0 and id % 2 <> 0 and id % 22 <> 1", ("shots",))
def fingerprints_pending(t):
    return similar.pending_fingerprints(t("shots"), _phashes(t), 0, 1 << 30)


@_query("select f.id as file_id, f.id * 10 as first_word, m.width, m.taken_at from shots f left join shot_meta m on m.file_id = f.id where f.status = 0 and f.id % 2 = 0", ("shots", "shot_meta"))
def fingerprints_loaded(t):
    d = similar.fingerprint_items(t("shots"), t("shot_meta"), _phashes(t))
    return d.select("file_id", F.element_at("hash", 1).alias("first_word"), "width", "taken_at")


@_query(None)
def similar_split(t):
    """Clusters that pictures without a time hold together are split by time."""
    items = _wide_items(t)
    return similar.similar_members(items, stored(similar.similar_clusters(items, 6, 4)))


_sql("similar_split", ("prints",), _WIDE + """, e6 as (select a, b from we where distance <= 6), u as (select a as x, b as y from e6 union select b, a from e6),
    r as (select node, min(l) as root from (with recursive r(node, l) as (select x, x from u union select u.y, r.l from r join u on u.x = r.node) select * from r) group by node),
    s as (select r.*, w.taken_at, (select count(distinct w2.taken_at) from r r2 join w w2 on w2.file_id = r2.node where r2.root = r.root) as stamps from r join w on w.file_id = r.node),
    k as (select node, root, case when stamps >= 2 then taken_at end as part from s where stamps < 2 or taken_at is not null)
    select min(node) over (partition by root, part) as group_id, node as file_id from k qualify count(*) over (partition by root, part) >= 2""")  # fmt: skip


# ---- libraries and plans

_LIB = "select n_nationkey as volume_id, 'D:\\L' || n_nationkey as path, n_nationkey = 3 as is_primary from nation where n_nationkey < 8"


def _libraries(t):
    k = F.col("n_nationkey").cast("long")
    return t("nation").where("n_nationkey < 8").select(k.alias("volume_id"), F.concat(F.lit("D:\\L"), k.cast("string")).alias("path"), (k == 3).alias("is_primary"))


@_query(f"select volume_id, chr((65 + volume_id)::int) as letter, path, is_primary from ({_LIB})")
def libraries_listed(t):
    v = _libraries(t).select("volume_id", F.char(65 + F.col("volume_id")).alias("letter"))
    return journal.list_libraries(_libraries(t), v)


@_query(f"select volume_id, path, volume_id = 0 as is_primary from ({_LIB}) where volume_id <> 3")
def library_removed(t):
    return journal.remove_library(_libraries(t), 3)


@_query(f"select * from ({_LIB}) where volume_id <> 5 union all select 5, 'E:\\New', false")
def library_set(t):
    return journal.set_library(_libraries(t), 5, "E:\\New")


@_query("select distinct n_regionkey + 5 as volume_id from nation where n_regionkey + 5 not in (select n_nationkey from nation where n_nationkey < 8)")
def libraries_missing(t):
    v = t("nation").select((F.col("n_regionkey") + 5).cast("long").alias("volume_id")).distinct()
    return organize.missing_libraries(v, _libraries(t))


@_query(f"select count(*) as n from files where {_SHOWN}", ("files",))
def organize_count(t):
    return organize.count_candidates(t("files"))


_ORG = ("shots", "shot_meta", "shot_hashes", "shot_disk")
_ITEM = f""", vh as (select f.*, {_PATH} as path, case when h.hashed_size = f.size and h.hashed_mtime = f.mtime then h.full_hash end as hash from shots f left join shot_hashes h on h.file_id = f.id),
    it as (select f.*, m.taken_at is not null and m.taken_at between 631152000000 and 1900086400000 as dated, p.id as p_id, p.path as p_path, p.status as p_status, p.hash as p_hash, p.size as p_size, p.mtime as p_mtime from vh f left join shot_meta m on m.file_id = f.id
        left join vh p on p.id = f.live_pair_id and p.live_pair_id = f.id and f.kind = 0 and p.kind = 1 where f.status in (0, 2) and (f.kind = 0 or f.live_pair_id is null)) """  # fmt: skip


def _shot_items(t):
    return organize.build_items(organize.candidates(t("shots"), t("shot_meta"), t("shot_hashes")), ["D:\\Shots"], LIBRARY, NOW, ZONE)


@_query(None)
def pair_items(t):
    d = _shot_items(t)
    return d.select("id", "rel_dir", "folder", "camera", "orig_stem", "hash_hex", F.col("pair.file_id").alias("pair_id"), F.col("pair.hash_hex").alias("pair_hash"), F.col("pair.size").alias("pair_size"), F.col("pair.status").alias("pair_status"))


_sql("pair_items", _ORG, _ITEM + """select it.id, case when dir_path like 'D:%' then substr(dir_path, 10) end as rel_dir, list_extract(string_split(dir_path, '\\'), -1) as folder,
    case when m.model is null then m.make when m.make is null then m.model else m.make || ' ' || m.model end as camera,
    regexp_replace(coalesce(original_name, name), '[.][^.]*$', '') as orig_stem, hash as hash_hex, p_id as pair_id, p_hash as pair_hash, p_size as pair_size, p_status as pair_status from it left join shot_meta m on m.file_id = it.id""")  # fmt: skip


_PAIR_FAR = "p_id is not null and p_path not like 'D:%' and p_hash is null"


@_query(None)
def pair_actions(t):
    """What the checks decide for files with pairs on two volumes; names with a hash."""
    f = templates.parse(templates.DEFAULT_FILE, False)
    d = _shot_items(t)
    return d.select("id", F.coalesce(organize.first_actions(d, LIBRARY, f), F.lit("PLACE")).alias("action"))


def _pair_action(status: str, p_status: str) -> str:
    return f"""case when {status} = 2 then 'SKIP_CLOUD' when {status} <> 0 then 'SKIP_MISSING' when not dated and name not similar to '.*[0-9]{{8,}}.*' then 'SKIP_UNCERTAIN' when {p_status} <> 0 then 'SKIP_PAIR_BLOCKED'
        when hash is null or ({_PAIR_FAR}) then 'NEEDS_HASH' else 'PLACE' end"""  # fmt: skip


_sql("pair_actions", _ORG, _ITEM + f"select id, {_pair_action('status', 'p_status')} as action from it")


@_query(None)
def pair_actions_on_disk(t):
    """The same after the disk was looked at: what has changed there counts as missing."""
    f = templates.parse(templates.DEFAULT_FILE, False)
    d = organize.source_state(_shot_items(t), t("shot_disk"))
    return d.select("id", F.coalesce(organize.first_actions(d, LIBRARY, f), F.lit("PLACE")).alias("action"))


_sql("pair_actions_on_disk", _ORG, _ITEM + f""", ck as (select it.*, case when it.status = 0 and not coalesce(d.size = it.size and d.mtime = it.mtime, false) then 1 else it.status end as st,
    case when p_status = 0 and not coalesce(e.size = p_size and e.mtime = p_mtime, false) then 1 else p_status end as p_st from it left join shot_disk d on d.file_id = it.id left join shot_disk e on e.file_id = it.p_id)
    select id, {_pair_action('st', 'p_st')} as action from ck""")  # fmt: skip


@_query(None)
def hashes_wanted(t):
    return organize.hashes_needed(_shot_items(t), LIBRARY, templates.parse("{name}", False))


_LIVE = "status = 0 and (dated or name similar to '.*[0-9]{8,}.*') and coalesce(p_status = 0, true)"
_sql("hashes_wanted", _ORG, _ITEM + f"select id as file_id from it where {_LIVE} and hash is null and path not like 'D:%' union select p_id from it where {_LIVE} and {_PAIR_FAR}")


@_query(f"select dir_path as folder, name, hash as full_hash from (select f.*, h.full_hash as hash from shots f join shot_hashes h on h.file_id = f.id where h.hashed_size = f.size and h.hashed_mtime = f.mtime and h.full_hash is not null) where status = 0 and id % 3 <> 0", ("shots", "shot_hashes"))
def hash_at_path(t):
    p = t("shots").where("id % 3 <> 0").select(F.col("dir_path").alias("folder"), "name")
    return organize.valid_hash_at_path(t("shots"), t("shot_hashes"), p)


@_query("""select f.id, case when f.status <> 0 then 'FREE' when f.id % 2 = 0 and h.hashed_size = f.size and h.hashed_mtime = f.mtime and h.full_hash is not null then 'SAME_CONTENT' else 'OCCUPIED' end as state
    from shots f left join shot_hashes h on h.file_id = f.id""", ("shots", "shot_hashes"))  # fmt: skip
def targets_probed(t):
    d = t("shots").join(t("shot_hashes").select(F.col("file_id").alias("id"), "full_hash"), "id", "left")
    d = d.select("id", F.lower("dir_path").alias("folder"), F.lower("name").alias("name"), F.when(F.col("id") % 2 == 0, F.col("full_hash")).otherwise(F.lit("other")).alias("hash_hex"))
    return organize.probe_target(d, t("shots"), t("shot_hashes"))


# ---- journal and jobs


@_query("select (select max(id) from ops) + row_number() over (order by batch_id, file_id, old_path, new_path) as id, batch_id, file_id, old_path, new_path, cast(null as bigint) as done_at from (select batch_id + 1000 as batch_id, file_id, new_path as old_path, old_path as new_path from ops where id % 3 = 0) union all select id, batch_id, file_id, old_path, new_path, done_at from ops", ("ops",))
def journal_appended(t):
    new = t("ops").where("id % 3 = 0").select((F.col("batch_id") + 1000).alias("batch_id"), "file_id", F.col("new_path").alias("old_path"), F.col("old_path").alias("new_path"))
    return journal.append_ops(t("ops"), new).select("id", "batch_id", "file_id", "old_path", "new_path", "done_at")


@_query("""select id, case when id % 5 = 1 then 7 else done_at end as done_at, case when id % 5 = 2 then 8 else undone_at end as undone_at, case when id % 5 = 4 and done_at is null then 9 else attempted_at end as attempted_at,
    case when id % 5 = 4 and done_at is null then 'WHY' end as recovery_error from ops where id % 5 <> 3""", ("ops",))  # fmt: skip
def journal_recorded(t):
    i = F.col("id") % 5
    event = F.when(i == 1, "DONE").when(i == 2, "UNDONE").when(i == 3, "DROPPED").when(i == 4, "FAILED")
    e = t("ops").select("id", event.alias("event"), F.when(i == 1, 7).when(i == 2, 8).otherwise(9).cast("long").alias("at"), F.when(i == 4, "WHY").alias("reason")).where("event is not null")
    return journal.record(t("ops"), e).select("id", "done_at", "undone_at", "attempted_at", "recovery_error")


@_query("select f.id as file_id, f.size, f.mtime, case when h.hashed_size = f.size and h.hashed_mtime = f.mtime then h.full_hash end as full_hash from shots f left join shot_hashes h on h.file_id = f.id", ("shots", "shot_hashes"))
def verify_facts(t):
    return journal.verify_context(t("shots"), t("shot_hashes"))


@_query("""select b.*, j.state, j.done as at from (select batch_id, count(*) filter (where done_at is not null and undone_at is null) as moved, count(undone_at) as undone from ops group by batch_id order by batch_id desc limit 50) b
    left join (select job_id, arg_max(state, event_id) as state, arg_max(done, event_id) as done from jobs group by job_id) j on j.job_id = b.batch_id""", ("ops", "jobs"))  # fmt: skip
def batches_with_jobs(t):
    return journal.batch_jobs(t("ops"), journal.latest_jobs(t("jobs")).withColumnRenamed("done", "at"))


@_query("select job_id, arg_max(state, event_id) as state from jobs group by job_id having arg_max(state, event_id) not in ('click', 'view')", ("jobs",))
def jobs_running(t):
    return journal.running(t("jobs"), ("click", "view")).select("job_id", "state")


@_query("select job_id, event_id, state, done from (select job_id, max(event_id) as event_id, arg_max(state, event_id) as state, arg_max(done, event_id) as done from (select event_id, job_id, state, done from jobs union all select max(event_id) + 1, 3, 'done', 100 from jobs) group by job_id) order by job_id desc limit 30", ("jobs",))
def jobs_listed(t):
    return journal.list_jobs(journal.with_event(t("jobs"), 3, "done", 100))


@_query(f"""with recursive x(y) as (select 1), m as (select id, 'E:\\Moved' as nd, name as nn from shots where id % 6 = 1),
    g as (select f.id from shots f join m on upper(f.dir_path) = upper(m.nd) and {_LOW('f.name')} = {_LOW('m.nn')} and f.id <> m.id where f.id not in (select id from m))
    select f.id, coalesce(m.nd, f.dir_path) as dir_path, coalesce(m.nn, f.name) as name, case when m.id is not null then coalesce(f.original_name, f.name) else f.original_name end as original_name from shots f left join m using (id) where f.id not in (select id from g)""")  # fmt: skip
def files_moved(t):
    return journal.move_files(t("shots"), t("shots").where("id % 6 = 1").select(F.col("id").alias("file_id"), F.lit("E:\\Moved").alias("new_dir"), F.col("name").alias("new_name")))


SQL["files_moved"] = SQL["files_moved"].replace("with recursive x(y) as (select 1),", catalog.ctes("shots") + ",")


# ---- windows and selections

_RANKED = f"select f.id, row_number() over (order by coalesce(m.taken_at, f.mtime) desc, f.id) as rank from files f left join meta m on m.file_id = f.id where {_SHOWN}"


@_query(f"select id, rank from ({_RANKED}) where rank between 51 and 250", ("files", "meta"))
def cached_window(t):
    cache = search.QueryCache()
    number, _ = cache.query(t("files"), t("meta"), FileFilter())
    return cache.window(number, 50, 200).select("id", "rank")


@_query(f"select id, rank from ({_RANKED}) r where rank between (select min(rank) from ({_RANKED}) where id in (12, 40)) and (select max(rank) from ({_RANKED}) where id in (12, 40))", ("files", "meta"))
def range_between_clicks(t):
    _, ids = search.QueryCache().query(t("files"), t("meta"), FileFilter())
    return search.shown_range(ids, 40, 12)


@_query("select group_id from (select distinct group_id + 200 as group_id from shot_groups) where group_id in (select group_id from shot_groups)", ("shot_groups",))
def selection_pruned(t):
    g = t("shot_groups").select("group_id").distinct()
    return search.prune_selection(g.select((F.col("group_id") + 200).alias("group_id")), g)


@_query(f"select f.id, f.name, f.size, {_PATH} as path, m.width, m.duration_ms from files f left join meta m on m.file_id = f.id where f.id = 12", ("files", "meta"))
def one_file(t):
    return search.file_detail(t("files"), t("meta"), 12).select("id", "name", "size", "path", "width", "duration_ms")


@_query(f"select f.id, {_PATH} as path, m.duration_ms from files f left join meta m on m.file_id = f.id where f.id = 40", ("files", "meta"))
def one_source(t):
    return search.media_src(t("files"), t("meta"), 40)


@_query("select id from files where status = 0 and id > 30 order by id limit 200", ("files",))
def present_page(t):
    return search.present_after(t("files"), 30, 200)


@_query(f"select id, {_PATH} as path from files where contains(lower(strip_accents(replace(replace(name, 'đ', 'd'), 'Đ', 'D'))), 'da lat') and {_SHOWN}", ("files",))
def stored_name_search(t):
    """The same search over a stored column of names without accents."""
    f = stored(search.with_search_name(t("files").drop("content")))
    d = search.filter_files(f, t("meta"), FileFilter(text="Đà Lạt", date_field="mtime"))
    return d.select("id", text.join_path(F.col("dir_path"), F.col("name")).alias("path"))


_ORDERS = {"size_desc": "f.size desc", "size_asc": "f.size", "date_asc": "coalesce(m.taken_at, f.mtime)", "name": _LOW("f.name"), "date_desc": "coalesce(m.taken_at, f.mtime) desc"}


@_query(" union all ".join(f"select '{k}' as sort, f.id, row_number() over (order by {v}, f.id) as pos from files f left join meta m on m.file_id = f.id where {_SHOWN}" for k, v in _ORDERS.items()), ("files", "meta"))
def sort_orders(t):
    """The place of every file in each order of the listing."""
    from functools import reduce

    cache = search.QueryCache()
    each = [cache.query(t("files"), t("meta"), FileFilter(sort=k))[1].select(F.lit(k).alias("sort"), "id", F.col("rank").alias("pos")) for k in ("size_desc", "size_asc")]
    kept = [stored(d) for d in each]  # the cache lets go of older ones
    for k in ("date_asc", "name", "date_desc"):
        kept.append(stored(cache.query(t("files"), t("meta"), FileFilter(sort=k))[1].select(F.lit(k).alias("sort"), "id", F.col("rank").alias("pos"))))
    return reduce(lambda a, b: a.unionByName(b), kept)
