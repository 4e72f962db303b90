"""State changes: an ordered command log folded into version, change and rename tables.

A command is (project, ord, verb, args_json, editor, at); ``ord`` orders the log. Commands that
share a key or a change, also through the rows that stand in a change, through renames or through a
reverted version, belong to one unit; a unit's commands are applied in order by one task. It gets
only the rows that the commands name, all other rows pass by. Only two cases make a whole project one
unit: a log that runs its scheduler, which is about all of its drafts, and a log with a reversal of more than ``block``
rows. A fold is serial, so the conflicts that only races cause can't occur.

``ord`` is unique in the log and ``first_id`` lies above all ids in use. A command's rows get
the ids first_id + ord * block + 0, 1, ... Only the reversal of a change can make more than
``block`` rows: it is given as many blocks as it can fill, and all later commands' ids move
up by these, so that ids stay distinct and in the order of the log.

Set forms for bulk work without conflicts (publish, publish due, seed) stand beside the fold.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import accumulate
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versotext.components import connected_components
from versotext.lineage import settled
from versotext.operators.versions import due_drafts
from versotext.schema import CHANGESETS, VERSIONS

BLOCK = 1000
BUNDLE = 2000
COMMANDS = "project string, ord long, verb string, args_json string, editor string, at timestamp"
ANSWERS = "project string, ord long, verb string, ok boolean, error string, result_json string"
RENAMES = "id long, project string, old_key string, new_key string, editor string, renamed_at timestamp"


class Refused(Exception):
    """A command's conflict: a marker and what it is about."""


class State:
    """A unit's rows as plain dicts, indexed by identity and by change, and the verbs."""

    def __init__(self, project: str, versions: list[dict], changes: list[dict], first_id: int, block: int, wide: list[tuple[int, int]]):
        self.project, self.block, self.first = project, block, first_id
        # commands with more than one block, in order, and the numbers of blocks added up to each
        self.wide, self.added = [o for o, _ in wide], [0, *accumulate(n for _, n in wide)]
        self.versions: dict[int, dict] = {}
        self.by_key: dict[str, dict[int, dict]] = defaultdict(dict)
        self.by_change: dict[int, dict[int, dict]] = defaultdict(dict)
        self.drafts: dict[tuple[str, str], dict[int, dict]] = defaultdict(dict)
        self.lives: dict[tuple[str, str], dict[int, dict]] = defaultdict(dict)
        self.published: dict[tuple[str, str], list[int]] = defaultdict(list)
        for v in sorted(versions, key=lambda v: v["id"]):
            self.put(v)
        self.changes = {c["id"]: c for c in changes}
        self.renames: list[dict] = []
        self.following = self.end = 0

    def begin(self, ord_: int) -> int:
        return self.first + (ord_ + self.added[bisect_left(self.wide, ord_)]) * self.block

    def new_id(self) -> int:
        if self.following >= self.end:
            raise OverflowError(f"a command of {self.project} makes more rows than it has ids")
        self.following += 1
        return self.following - 1

    # rows and their indexes

    def put(self, v: dict) -> None:
        n, identity = v["id"], (v["key"], v["locale"])
        self.versions[n] = self.by_key[v["key"]][n] = v
        if v["changeset_id"] is not None:
            self.by_change[v["changeset_id"]][n] = v
        if v["state"] == "draft":
            self.drafts[identity][n] = v
        if v["is_active"]:
            self.lives[identity][n] = v
        if v["state"] == "published":
            insort(self.published[identity], n)

    def drop(self, v: dict) -> None:
        n, identity = v["id"], (v["key"], v["locale"])
        for index in (self.versions, self.by_key[v["key"]], self.by_change[v["changeset_id"]], self.drafts[identity], self.lives[identity]):
            index.pop(n, None)
        if v["state"] == "published":
            own = self.published[identity]
            del own[bisect_left(own, n)]

    def update(self, v: dict, fields: dict) -> None:
        self.drop(v)
        v |= fields
        self.put(v)

    def draft(self, key: str, locale: str) -> dict | None:
        return next(iter(self.drafts[key, locale].values()), None)

    def active(self, key: str, locale: str) -> dict | None:
        return next(iter(self.lives[key, locale].values()), None)

    def retire(self, key: str, locale: str) -> None:
        for v in list(self.lives[key, locale].values()):
            self.update(v, {"is_active": False})

    def members(self, change: int, state: str = "draft") -> list[dict]:
        return sorted((v for v in self.by_change[change].values() if v["state"] == state), key=lambda v: v["id"])

    def change(self, n: int, statuses: tuple[str, ...] = ("open", "scheduled")) -> dict:
        found = self.changes.get(n)
        if found is None:
            raise Refused(f"no_change:{n}")
        if found["project"] != self.project:
            raise Refused(f"wrong_project:{self.project}")
        if found["status"] not in statuses:
            raise Refused(f"change_closed:{n}")
        return found

    # verbs: each takes its arguments, the editor and the time, and gives an answer

    def save(self, a: dict, editor: str | None, at: str) -> Any:
        key, locale, wanted = a["key"], a.get("locale", "default"), a.get("change", -1)
        change = self.change(wanted) if wanted not in (None, -1) else None
        held = self.draft(key, locale)
        effective = (held or {}).get("changeset_id") if wanted == -1 else wanted
        if effective is not None and wanted == -1:
            change = self.changes.get(effective)
            effective = effective if change else None
        if effective is not None and a.get("publish_at") is not None:
            raise Refused(f"grouped_schedule:{key}")
        stamp = change["publish_at"] if effective is not None else a.get("publish_at")
        fields = {"value_json": json.dumps(a["value"], sort_keys=True, ensure_ascii=False, separators=(",", ":")), "target": a.get("target"), "editor": editor, "label": a.get("label"), "note": a.get("note"), "publish_at": stamp, "changeset_id": effective}
        if held:
            if held["editor"] != editor and not a.get("force"):
                raise Refused(f"draft_held:{held['editor'] or ''}")
            self.update(held, fields)
            return held["id"]
        new = self.blank(key, locale, at) | fields | {"state": "draft", "is_active": False}
        self.put(new)
        return new["id"]

    def blank(self, key: str, locale: str, at: str) -> dict:
        names = ("target", "value_json", "publish_at", "label", "note", "editor", "published_by", "reverted_from", "published_at", "changeset_id")
        return {"id": self.new_id(), "project": self.project, "key": key, "locale": locale, "created_at": at} | dict.fromkeys(names)

    def flip(self, key: str, locale: str, editor: str | None, at: str, keep_change: bool) -> int:
        held = self.draft(key, locale)
        if held is None:
            raise Refused(f"no_draft:{key} ({locale})")
        self.retire(key, locale)
        self.update(held, {"state": "published", "is_active": True, "published_by": editor, "publish_at": None, "published_at": at, "changeset_id": held["changeset_id"] if keep_change else None})
        return held["id"]

    def publish(self, a: dict, editor: str | None, at: str) -> Any:
        return self.flip(a["key"], a.get("locale", "default"), editor, at, False)

    def discard(self, a: dict, editor: str | None, at: str) -> Any:
        held = self.draft(a["key"], a.get("locale", "default"))
        if held is None:
            raise Refused(f"no_draft:{a['key']} ({a.get('locale', 'default')})")
        self.drop(held)
        return held["id"]

    def revert(self, a: dict, editor: str | None, at: str) -> Any:
        source = self.versions.get(a["version"])
        if source is None:
            raise Refused(f"no_version:{a['version']}")
        if source["project"] != self.project:
            raise Refused(f"wrong_project:{self.project}")
        if source["state"] != "published":
            raise Refused(f"not_published:{a['version']}")
        live = self.active(source["key"], source["locale"])
        if a.get("expect_active") is not None and (live or {}).get("id") != a["expect_active"]:
            raise Refused(f"stale_active:{source['key']}")
        self.retire(source["key"], source["locale"])
        new = self.blank(source["key"], source["locale"], at) | {"target": source["target"], "value_json": source["value_json"], "editor": editor, "published_by": editor, "published_at": at, "reverted_from": source["id"], "state": "published", "is_active": True}
        self.put(new)
        return new["id"]

    def rename(self, a: dict, editor: str | None, at: str) -> Any:
        if self.by_key[a["new_key"]]:
            raise Refused(f"key_taken:{a['new_key']}")
        moved = list(self.by_key[a["old_key"]].values())
        for v in moved:
            self.update(v, {"key": a["new_key"]})
        self.renames.append({"id": self.new_id(), "project": self.project, "old_key": a["old_key"], "new_key": a["new_key"], "editor": editor, "renamed_at": at})
        return len(moved)

    def open_change(self, a: dict, editor: str | None, at: str) -> Any:
        n = self.new_id()
        self.changes[n] = {"id": n, "project": self.project, "name": a.get("name"), "note": a.get("note"), "status": "open", "author_kind": a.get("author_kind", "human"), "publish_at": None, "created_at": at, "reverted_at": None}
        return n

    def schedule_change(self, a: dict, editor: str | None, at: str) -> Any:
        change, stamp = self.change(a["change"]), a.get("publish_at")
        members = self.members(a["change"])
        if stamp is not None and not members:
            raise Refused(f"no_members:{a['change']}")
        change |= {"publish_at": stamp, "status": "scheduled" if stamp is not None else "open"}
        for v in members:
            self.update(v, {"publish_at": stamp})
        return len(members)

    def publish_change(self, a: dict, editor: str | None, at: str) -> Any:
        change = self.change(a["change"])
        members = self.members(a["change"])
        if not members:
            raise Refused(f"no_members:{a['change']}")
        out = [[v["key"], v["locale"], self.flip(v["key"], v["locale"], editor, at, True)] for v in members]
        change |= {"status": "published", "publish_at": None}
        return out

    def abandon_change(self, a: dict, editor: str | None, at: str) -> Any:
        self.change(a["change"])
        members = self.members(a["change"])
        for v in members:
            self.drop(v)
        del self.changes[a["change"]]
        return len(members)

    def revert_change(self, a: dict, editor: str | None, at: str) -> Any:
        change = self.change(a["change"], ("published",))
        out = []
        for v in self.members(a["change"], "published"):
            own = self.published[v["key"], v["locale"]]
            place = bisect_left(own, v["id"])
            if not place:
                out.append([v["key"], v["locale"], "no_prior_version"])
                continue
            try:
                out.append([v["key"], v["locale"], self.revert({"version": own[place - 1], "expect_active": v["id"]}, editor, at)])
            except Refused as e:
                out.append([v["key"], v["locale"], str(e).split(":")[0]])
        change["reverted_at"] = at
        return out

    def publish_due(self, a: dict, editor: str | None, at: str) -> Any:
        out = []
        due = [v for v in sorted(self.versions.values(), key=lambda v: v["id"]) if v["state"] == "draft" and v["publish_at"] is not None and v["publish_at"] <= at]
        for v in due:
            if v["changeset_id"] is None:
                out.append([v["key"], v["locale"], self.flip(v["key"], v["locale"], editor, at, False)])
        for c in sorted({v["changeset_id"] for v in due if v["changeset_id"] is not None}):
            if (self.changes.get(c) or {}).get("status") == "scheduled":
                out += self.publish_change({"change": c}, editor, at)
        for c in self.changes.values():
            if c["status"] == "scheduled" and c["publish_at"] is not None and c["publish_at"] <= at and not self.members(c["id"]):
                c |= {"status": "open", "publish_at": None}
        return out

    def apply(self, ord_: int, verb: str, args: dict, editor: str | None, at: str) -> tuple[bool, str | None, Any]:
        self.following, self.end = self.begin(ord_), self.begin(ord_ + 1)
        if verb not in VERBS:
            return False, f"unknown_verb:{verb}", None
        try:
            return True, None, getattr(self, verb)(args, editor, at)
        except Refused as e:
            return False, str(e), None


VERBS = ("save", "publish", "discard", "revert", "rename", "open_change", "schedule_change", "publish_change", "abandon_change", "revert_change", "publish_due")


def _packed(rows: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    stamped = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if rows.schema[c].dataType.typeName() == "timestamp" else F.col(c) for c in columns]
    return rows.select("project", "unit", F.lit(kind).alias("kind"), F.to_json(F.struct(*stamped), {"ignoreNullFields": "false"}).alias("body"))


def _node(kind: str, value: str) -> Column:
    """A node of the graph of units; two nodes taken for one only make a unit larger."""
    return F.xxhash64(F.lit(kind), "project", F.col(value).cast("string"))


def _units(commands: DataFrame, named: DataFrame, by_version: DataFrame, inside: DataFrame, first_id: int, block: int) -> DataFrame:
    """``node, component``: keys, changes and commands that must be folded together."""
    arg = lambda name: F.element_at(F.from_json("args_json", "map<string,string>"), F.lit(name)).cast("long")
    asked = commands.select("project", "ord", "verb", arg("change").alias("change"), arg("version").alias("version"))
    made = asked.where("verb = 'open_change'").withColumn("change", F.lit(first_id) + F.col("ord") * block)
    later = asked.where(F.col("version") >= first_id).withColumn("maker", F.floor((F.col("version") - first_id) / block).cast("long"))
    own = _node("command", "ord").alias("a")
    return connected_components(
        named.unionByName(by_version).select(own, _node("key", "key").alias("b"))
        .unionByName(asked.where("change is not null and change <> -1").unionByName(made).select(own, _node("change", "change").alias("b")))
        .unionByName(later.select(own, _node("command", "maker").alias("b")))
        .unionByName(inside.where("changeset_id is not null").select(_node("key", "key").alias("a"), _node("change", "changeset_id").alias("b")).distinct())
    )


def _wide(versions: DataFrame, asked: DataFrame, block: int) -> list[tuple[int, int]]:
    """Commands that can make more than ``block`` rows, with the blocks they need besides the first.

    A reversal makes at most a row for each version that is in the change or that the log saves into it.
    """
    reverts = asked.where("verb = 'revert_change' and changeset_id is not null").select("project", "changeset_id", "ord")
    held = versions.where("changeset_id is not null").select("project", "changeset_id").unionByName(asked.where("verb = 'save' and changeset_id is not null").select("project", "changeset_id"))
    sizes = held.join(reverts.select("project", "changeset_id").distinct(), ["project", "changeset_id"], "left_semi").groupBy("project", "changeset_id").agg(F.count("*").alias("n"))
    # one row for each reversal of a change above the block
    rows = reverts.join(sizes.where(F.col("n") > block), ["project", "changeset_id"]).select("ord", "n").collect()
    return sorted((r["ord"], -(-r["n"] // block) - 1) for r in rows)


def fold(versions: DataFrame, changes: DataFrame, commands: DataFrame, first_id: int, block: int = BLOCK) -> dict[str, DataFrame]:
    """``versions``, ``changesets``, ``renames`` (new ones) and ``answers`` after the commands."""
    args = F.from_json("args_json", "map<string,string>")
    named = commands.select("project", "ord", F.explode(F.array(F.element_at(args, F.lit("key")), F.element_at(args, F.lit("old_key")), F.element_at(args, F.lit("new_key")))).alias("key")).where("key is not null")
    by_version = commands.select("project", "ord", F.element_at(args, F.lit("version")).cast("long").alias("id")).where("id is not null").join(versions.select("project", "id", "key"), ["project", "id"]).select("project", "ord", "key")
    asked = commands.select("project", F.element_at(args, F.lit("change")).cast("long").alias("changeset_id"), "verb", "at", "ord")
    by_change = versions.join(asked.where("changeset_id is not null").select("project", "changeset_id").distinct(), ["project", "changeset_id"], "left_semi").select("project", "key")
    due_at = asked.where("verb = 'publish_due'").groupBy("project").agg(F.max("at").alias("due"))
    by_due = versions.join(due_at, "project").where("state = 'draft' and publish_at <= due").select("project", "key", "changeset_id")
    with_due = versions.join(by_due.where("changeset_id is not null").select("project", "changeset_id").distinct(), ["project", "changeset_id"], "left_semi").select("project", "key")
    # a rename of a key that is named, or a draft saved to a held change, needs no further rows
    touched = named.unionByName(by_version).select("project", "key").unionByName(by_change).unionByName(by_due.select("project", "key")).unionByName(with_due).distinct()
    touched = settled(touched)
    inside = versions.join(touched, ["project", "key"], "left_semi").select(versions.columns)
    outside = versions.join(touched, ["project", "key"], "left_anti").select(versions.columns)
    wide = _wide(versions, asked, block)
    # where the scheduler runs, or ids don't tell which command made them, the project is the unit
    whole = commands.select("project").distinct() if wide else due_at.select("project")
    whole = whole.withColumn("__whole", F.xxhash64("project"))
    units = settled(_units(commands, named, by_version, inside, first_id, block))

    def placed(rows: DataFrame, kind: str, value: str) -> DataFrame:
        """The rows with their unit, null for what no command has to do with."""
        joined = rows.withColumn("node", _node(kind, value)).join(units, "node", "left").join(whole, "project", "left")
        return joined.withColumn("unit", F.coalesce("__whole", F.col("component")))

    own_changes = placed(changes, "change", "id")
    told = placed(commands, "command", "ord").withColumn("unit", F.coalesce("unit", "node"))
    packed = _packed(placed(inside, "key", "key"), "version", versions.columns).unionByName(_packed(own_changes.where("unit is not null"), "changeset", changes.columns)).unionByName(_packed(told, "command", commands.columns))

    def one(project: str, bodies: dict[str, list[dict]]) -> list[tuple[str, str]]:
        state = State(project, bodies["version"], bodies["changeset"], first_id, block, wide)
        out: list[tuple[str, str]] = []
        for c in sorted(bodies["command"], key=lambda c: c["ord"]):
            ok, error, result = state.apply(c["ord"], c["verb"], json.loads(c["args_json"] or "{}"), c["editor"], c["at"])
            out.append(("answer", json.dumps({"project": project, "ord": c["ord"], "verb": c["verb"], "ok": ok, "error": error, "result_json": json.dumps(result)})))
        return out + [("version", json.dumps(v)) for v in state.versions.values()] + [("changeset", json.dumps(v)) for v in state.changes.values()] + [("rename", json.dumps(v)) for v in state.renames]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[tuple[str, int], dict[str, list[dict]]] = defaultdict(lambda: {"version": [], "changeset": [], "command": []})
        for project, unit, kind, body in zip(pdf["project"], pdf["unit"], pdf["kind"], pdf["body"], strict=True):
            found[project, unit][kind].append(json.loads(body))
        return pd.DataFrame([r for (project, _), bodies in found.items() for r in one(project, bodies)], columns=["kind", "body"])

    packed = settled(packed)
    # a task folds many small units, about BUNDLE rows in all
    bundles = -(-packed.count() // BUNDLE) + 1
    packed = packed.withColumn("bundle", F.pmod(F.xxhash64("project", "unit"), F.lit(bundles)))
    folded = settled(packed.groupBy("bundle").applyInPandas(run, "kind string, body string"))
    unpack = lambda kind, schema: folded.where(F.col("kind") == kind).select(F.from_json("body", schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}).alias("r")).select("r.*")
    return {
        "versions": outside.unionByName(unpack("version", VERSIONS).select(versions.columns)), "changesets": own_changes.where("unit is null").select(changes.columns).unionByName(unpack("changeset", CHANGESETS).select(changes.columns)),
        "renames": unpack("rename", RENAMES), "answers": unpack("answer", ANSWERS),
    }


# --- set forms ---------------------------------------------------------------------

def publish_set(versions: DataFrame, identities: DataFrame, editor: str, at: Column, keep_change: bool = False) -> DataFrame:
    """Versions after publishing the drafts of many identities (project, key, locale) at once; others stay as they are."""
    drafts = versions.where("state = 'draft'").join(identities.select("project", "key", "locale").distinct(), ["project", "key", "locale"], "left_semi").select(F.col("id").alias("__flip"), "project", "key", "locale")
    joined = versions.join(drafts, ["project", "key", "locale"], "left")
    flips, loses = F.col("id") == F.col("__flip"), F.col("__flip").isNotNull() & F.col("is_active")
    put = {
        "state": F.when(flips, "published").otherwise(F.col("state")), "is_active": F.when(flips, True).when(loses, False).otherwise(F.col("is_active")), "published_by": F.when(flips, F.lit(editor)).otherwise(F.col("published_by")),
        "published_at": F.when(flips, at).otherwise(F.col("published_at")), "publish_at": F.when(~flips | flips.isNull(), F.col("publish_at")), "changeset_id": F.col("changeset_id") if keep_change else F.when(~flips | flips.isNull(), F.col("changeset_id")),
    }
    return joined.withColumns(put).select(versions.columns)


def publish_due_set(versions: DataFrame, changes: DataFrame, now: Column, editor: str) -> tuple[DataFrame, DataFrame]:
    """Versions and changes after a scheduler's turn: due drafts alone, whole scheduled changes, and empty due changes reopened."""
    due = due_drafts(versions, now)
    ripe = changes.where("status = 'scheduled'").join(due.select(F.col("changeset_id").alias("id")).distinct(), "id", "left_semi").select("id")
    alone = due.where("changeset_id is null").select("project", "key", "locale")
    grouped = versions.where("state = 'draft'").join(ripe.withColumnRenamed("id", "changeset_id"), "changeset_id", "left_semi").select("project", "key", "locale")
    out = publish_set(publish_set(versions, alone, editor, now), grouped, editor, now, keep_change=True)
    full = versions.where("state = 'draft' and changeset_id is not null").select(F.col("changeset_id").alias("id")).distinct().withColumn("__full", F.lit(True))
    done = ripe.withColumn("__done", F.lit(True))
    joined = changes.join(done, "id", "left").join(full, "id", "left")
    reopened = (F.col("status") == "scheduled") & (F.col("publish_at") <= now) & F.col("__full").isNull()
    status = F.when(F.col("__done"), "published").when(reopened, "open").otherwise(F.col("status"))
    return out, joined.withColumn("publish_at", F.when(~F.coalesce("__done", F.lit(False)) & ~reopened, F.col("publish_at"))).withColumn("status", status).select(changes.columns)


def seed_set(keys: DataFrame, snapshot: DataFrame, versions: DataFrame, project: str, editor: str, at: Column, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Versions with the snapshot's default value published for every declared key that has none, and an outcome for each key.

    Outcomes: seeded, already_stored, has_draft, derived, no_value.
    """
    own = versions.where((F.col("project") == project) & (F.col("locale") == "default"))
    held = own.groupBy("key").agg(F.bool_or(F.col("state") != "draft").alias("stored"), F.bool_or(F.col("state") == "draft").alias("drafted"))
    values = snapshot.where("locale = 'default'").select("key", "value_json")
    joined = keys.select("key", "target", (F.col("derives_from").isNotNull() & F.col("tmpl").isNotNull()).alias("derived")).join(held, "key", "left").join(values, "key", "left")
    outcome = F.when(F.col("derived"), "derived").when(F.col("stored"), "already_stored").when(F.col("drafted"), "has_draft").when(F.col("value_json").isNull(), "no_value").otherwise("seeded")
    told = joined.withColumn("outcome", outcome)
    # ids need only be new and distinct; the partition's number and the row's place in it give both without a global sort
    blank = {c.name: F.lit(None).cast(c.dataType) for c in versions.schema}
    new = told.where("outcome = 'seeded'").select(*[
        {"id": F.lit(first_id) + F.monotonically_increasing_id(), "project": F.lit(project), "key": F.col("key"), "locale": F.lit("default"), "target": F.col("target"), "value_json": F.col("value_json"), "state": F.lit("published"), "is_active": F.lit(True), "editor": F.lit(editor), "published_by": F.lit(editor), "created_at": at, "published_at": at}.get(name, empty).alias(name)
        for name, empty in blank.items()
    ])
    return versions.unionByName(new), told.select("key", "outcome")
