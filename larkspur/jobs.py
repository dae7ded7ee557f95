"""Jobs over stored collections: archive export and import with a dry run, ingest and emit, layout migration, index rebuild, retention maintenance, scope erasure.

`python -m larkspur.jobs COMMAND ...` runs them; each prints one JSON object.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import algebra, index, lifecycle
from .plans.ast import QueryError
from .plans.compile import Typed
from .plans.planner import Index
from .sources import files
from .sources.storage import Store


def live_rows(store: Store, name: str) -> DataFrame:
    rows = store.read(name)
    if rows is None:
        raise QueryError(f"No such collection: {name}")
    rows = rows.drop("bucket")
    return lifecycle.live(rows) if "deleted_at" in rows.columns else rows


def export(store: Store, name: str, path: str, with_deleted: bool = False) -> dict:
    rows = store.read(name).drop("bucket") if with_deleted else live_rows(store, name)
    return files.export_archive(rows, path, f"{name}.ndjson", with_deleted)


def import_archive(store: Store, name: str, path: str, schema: str, mode: str = "create", dry_run: bool = False) -> dict:
    """An archive into a collection. Its checksum is verified before, the stored rows after; a dry run writes nothing and says what would be."""
    entry = files.validate_archive(store.spark, path, f"{name}.ndjson")
    new = store.spark.read.schema(schema).json(f"{path}/{name}.ndjson")
    old = store.read(name)
    before = lifecycle.live(old.drop("bucket")) if old is not None and "deleted_at" in old.columns else old.drop("bucket") if old is not None else None
    target = new.limit(0) if before is None else before.select(*new.columns)
    wanted = algebra.import_into(target, new, "id", mode)
    out = {"collection": name, "mode": mode, "records": entry["records"], "total": wanted.count(), "dryRun": dry_run}
    if not dry_run:
        store.commit(name, lambda rows: lifecycle.stored(wanted))
        r = algebra.difference(live_rows(store, name).select(*new.columns), wanted).first()
        if r["only_left"] or r["only_right"]:
            raise QueryError(f"{name}: stored rows differ from the import")
    return out


def ingest(store: Store, name: str, docs: DataFrame, mode: str = "create") -> dict:
    """Documents of any source into a collection; ids that occur twice are refused."""
    twice = lifecycle.duplicate_ids(docs, "id").limit(1).collect()
    if twice:
        raise QueryError(f"{name}: id {twice[0]['id']} occurs twice")
    old = store.read(name)
    target = docs.limit(0) if old is None else live_rows(store, name).select(*docs.columns)
    wanted = algebra.import_into(target, docs, "id", mode)
    return {"collection": name, "records": store.commit(name, lambda rows: lifecycle.stored(wanted)).records}


def emit(store: Store, name: str, path: str, kind: str) -> dict:
    rows = live_rows(store, name)
    {"json": files.write_json, "csv": files.write_csv}[kind](rows, path)
    return {"collection": name, "kind": kind, "records": rows.count()}


def migrate_layout(store: Store, name: str, layout: str) -> dict:
    """Rewrite in another layout. Collections with deletions are refused; rows are compared after."""
    head = store.head(name)
    if head.tombstones:
        raise QueryError(f"{name} holds deletions; purge them first")
    before = store.read(name, head=head).drop("bucket")
    after = store.commit(name, lambda rows: rows.drop("bucket"), layout=layout)
    r = algebra.difference(before, store.read(name, head=after).select(*before.columns)).first()
    if r["only_left"] or r["only_right"]:
        raise QueryError(f"{name}: rows differ after the migration")
    return {"collection": name, "layout": layout, "revision": after.revision}


def rebuild_index(store: Store, name: str, definition: Index, path: str, kept: DataFrame | None = None) -> dict:
    """Write an index's table anew from the documents; kept: the table kept up by updates, whose differences are counted."""
    rows = live_rows(store, name)
    fresh = index.build(rows, definition, Typed(rows.schema))
    r = algebra.difference(kept.select(*fresh.columns), fresh).first() if kept is not None else None
    index.write(fresh, definition, path)
    return {"collection": name, "index": definition.name, "differences": int(r["only_left"] + r["only_right"]) if r else None} | index.stats(fresh, definition).first().asDict()


def maintain(store: Store, names: list[str], now: str) -> list[dict]:
    """Purge deletions whose time is over and delete generations that no manifest names, collection by collection. Only while no one writes."""
    out = []
    for name in names:
        before = store.head(name)
        after = store.commit(name, lambda rows: lifecycle.purge(rows.drop("bucket"), now)) if before.tombstones else before
        out.append({"collection": name, "purged": before.tombstones - after.tombstones, "generations": store.compact(name)})
    return out


def erase(store: Store, names: list[str], now: str) -> list[dict]:
    """Mark all documents of the collections as deleted."""
    out = []
    for name in names:
        before = store.head(name)
        after = store.commit(name, lambda rows: lifecycle.erase_all(rows.drop("bucket"), now))
        out.append({"collection": name, "erased": after.tombstones - before.tombstones})
    return out


def purge_scope(store: Store, names: list[str], now: str) -> list[dict]:
    """Delete the collections of a scope for good, if nothing in them is live or may still be restored; all are looked at before any goes."""
    for name in names:
        if not store.head(name).revision:
            raise QueryError(f"No such collection: {name}")
        rows = store.read(name)
        held = 0 if rows is None else rows.count() if "deleted_at" not in rows.columns else lifecycle.purge(rows.drop("bucket"), now).count()
        if held:
            raise QueryError(f"{name} holds {held} documents that are live or may be restored")
    out = []
    for name in names:
        out.append({"collection": name, "purged": store.head(name).records})
        store.drop(name)
    return out


def rewrite(store: Store, name: str, change) -> dict:
    """Every document through change (a function of DataFrames that keeps ids, as for new metadata or keys), verified after: the same ids, each once, and the rows that were meant."""
    before = store.read(name)
    if before is None:
        raise QueryError(f"No such collection: {name}")
    wanted = change(before.drop("bucket"))
    ids = algebra.difference(before.select("id"), wanted.select("id")).first()
    if ids["only_left"] or ids["only_right"]:
        raise QueryError(f"{name}: the rewrite changes ids")
    head = store.head(name)
    after = store.commit(name, lambda rows: change(rows.drop("bucket")), expected_revision=head.revision)
    r = algebra.difference(wanted, store.read(name, head=after).select(*wanted.columns)).first()
    if r["only_left"] or r["only_right"]:
        raise QueryError(f"{name}: stored rows differ from the rewrite")
    return {"collection": name, "revision": after.revision, "records": after.records}


def inspect(store: Store, name: str) -> dict:
    head = store.head(name)
    return {"collection": name} | {k: getattr(head, k) for k in ("revision", "layout", "records", "tombstones")} | {"parts": len(head.parts)}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("command", choices=("export", "validate", "import", "emit", "migrate", "maintain", "erase", "purge", "inspect"))
    p.add_argument("store")
    p.add_argument("name", nargs="+")
    p.add_argument("--path", default="")
    p.add_argument("--scope", default="public")
    p.add_argument("--schema", default="id string")
    p.add_argument("--mode", default="create")
    p.add_argument("--kind", default="json")
    p.add_argument("--layout", default="bucketed")
    p.add_argument("--now", default="")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("larkspur").getOrCreate()
    store, name = Store(spark, a.store, a.scope), a.name[0]
    now = a.now or str(spark.range(1).select(F.current_timestamp().cast("timestamp_ntz")).first()[0])
    done = {
        "export": lambda: export(store, name, a.path), "validate": lambda: files.validate_archive(spark, a.path, f"{name}.ndjson"), "import": lambda: import_archive(store, name, a.path, a.schema, a.mode, a.dry_run),
        "emit": lambda: emit(store, name, a.path, a.kind), "migrate": lambda: migrate_layout(store, name, a.layout), "maintain": lambda: maintain(store, a.name, now), "erase": lambda: erase(store, a.name, now), "purge": lambda: purge_scope(store, a.name, now), "inspect": lambda: inspect(store, name),
    }[a.command]()
    print(json.dumps(done))


if __name__ == "__main__":
    main()
