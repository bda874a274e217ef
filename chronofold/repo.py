"""A repository on disk: listings and objects as Parquet tables, names and settings as small JSON files.

Every root tree is a full listing below ``trees/<id>``; objects are appended to ``objects``; commits and
tags are JSON lines, as they are few; conflicts are a Parquet table below ``conflicts``. Names are replaced atomically, with a check of the old value.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import shutil
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bounds, revisions, values, wkt
from .functions import paths as pathing
from .functions.ids import NULL_ID
from .operators import diff as diffs
from .operators import merge as merges
from .operators import patch as patches
from .operators.snapshots import PATH
from .workspace import materialize

LISTING = "parent_path string, ref_name string, ref_type string, object_id string, metadata_id string, minx double, maxx double, miny double, maxy double"
CONFLICTS = "parent_path string, ref_name string, ancestor string, ours string, theirs string"
EMPTY = "empty"


class ConflictError(Exception):
    """A merge that can't be done without deciding conflicts; they are stored in the repository."""


class Repo:
    """The commands of a versioned store. Trees are named by WORK_HEAD and STAGE_HEAD until they are committed."""

    def __init__(self, spark: SparkSession, path: str, transaction: str | None = None) -> None:
        self.spark, self.path, self.transaction_id = spark, os.path.abspath(path), transaction
        self._names = f"transactions/{transaction}.json" if transaction else "refs.json"
        self.hooks: dict[str, list[Callable]] = {}
        if not os.path.exists(self._file("refs.json")):
            raise FileNotFoundError(f"no repository at {path}; use Repo.init")

    # -- files --------------------------------------------------------------------------------------

    @classmethod
    def init(cls, spark: SparkSession, path: str, config: dict[str, str] | None = None) -> Repo:
        """Create a repository, or open the one that is there."""
        os.makedirs(os.path.join(path, "trees"), exist_ok=True)
        refs = os.path.join(path, "refs.json")
        if not os.path.exists(refs):
            with open(refs, "w") as f:
                json.dump({"HEAD": "refs/heads/master", "WORK_HEAD": EMPTY, "STAGE_HEAD": EMPTY}, f)
        out = cls(spark, path)
        for k, v in (config or {}).items():
            out.config_set(k, v)
        return out

    @staticmethod
    def find(path: str) -> str | None:
        """The repository folder at or above ``path``."""
        path = os.path.abspath(path)
        while not os.path.exists(os.path.join(path, "refs.json")):
            path, below = os.path.dirname(path), path
            if path == below:
                return None
        return path

    def _file(self, *parts: str) -> str:
        return os.path.join(self.path, *parts)

    def _read(self, name: str, default):
        try:
            with open(self._file(name)) as f:
                return json.load(f)
        except FileNotFoundError:
            return default

    def _write(self, name: str, value) -> None:
        tmp = self._file(f"{name}.{uuid.uuid4().hex}.new")
        with open(tmp, "w") as f:
            json.dump(value, f, indent=1, sort_keys=True)
        os.replace(tmp, self._file(name))

    @contextlib.contextmanager
    def _locked(self) -> Iterator[None]:
        lock, until = self._file("lock"), time.time() + 30
        while True:
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                if time.time() > until:
                    raise TimeoutError("the repository is locked") from None
                time.sleep(0.05)
        try:
            yield
        finally:
            os.unlink(lock)

    # -- hooks and settings ---------------------------------------------------------------------------

    def on(self, event: str, call: Callable) -> None:
        """Call ``call(repo, **arguments)`` at ``pre_<command>`` or ``post_<command>``; an exception before stops the command."""
        self.hooks.setdefault(event, []).append(call)

    def _fire(self, event: str, **arguments) -> None:
        for call in self.hooks.get(event, []):
            call(self, **arguments)

    @staticmethod
    def global_file() -> str:
        """Settings of all repositories of a user: ``CHRONOFOLD_CONFIG`` or a file in the home folder."""
        return os.environ.get("CHRONOFOLD_CONFIG") or os.path.expanduser("~/.chronofold.json")

    def _settings(self, everywhere: bool) -> str:
        return self.global_file() if everywhere else self._file("config.json")

    def config_get(self, key: str, default: str | None = None, everywhere: bool | None = None) -> str | None:
        """A setting: the repository's own, else the user's; ``everywhere`` asks for one of the two alone."""
        if everywhere is None:
            return self.config_get(key, None, False) or self.config_get(key, default, True)
        return self._read(self._settings(everywhere), {}).get(key, default)

    def config_set(self, key: str, value: str | None, everywhere: bool = False) -> None:
        """Set a ``section.key``; null unsets it."""
        if "." not in key:
            raise ValueError("a setting is section.key")
        c = self._read(self._settings(everywhere), {})
        c.pop(key, None)
        if value is not None:
            c[key] = value
        self._write(self._settings(everywhere), c)

    def config_remove_section(self, section: str, everywhere: bool = False) -> None:
        name = self._settings(everywhere)
        self._write(name, {k: v for k, v in self._read(name, {}).items() if not k.startswith(section + ".")})

    def config_list(self, everywhere: bool = False) -> dict[str, str]:
        return self._read(self._settings(everywhere), {})

    # -- names ----------------------------------------------------------------------------------------

    def refs(self, prefix: str = "") -> dict[str, str]:
        return {k: v for k, v in self._read(self._names, {}).items() if k.startswith(prefix)}

    def update_ref(self, name: str, new: str | None, old: str | None = None) -> None:
        """Set or (null) delete a name; with ``old`` only if it still has that value."""
        with self._locked():
            r = self._read(self._names, {})
            if old is not None and r.get(name) != old:
                raise ValueError(f"{name} has changed")
            r.pop(name, None)
            if new is not None:
                r[name] = new
            self._write(self._names, r)

    @property
    def branch(self) -> str | None:
        """The current branch, or null if HEAD names a commit."""
        head = self.refs()["HEAD"]
        return head if head.startswith("refs/") else None

    @property
    def head(self) -> str | None:
        r = self.refs()
        return r.get(r["HEAD"]) if r["HEAD"].startswith("refs/") else r["HEAD"]

    def commits(self) -> dict[str, dict]:
        """All commits by id, in the order made."""
        try:
            with open(self._file("commits.jsonl")) as f:
                return {c["commit_id"]: c for c in map(json.loads, f)}
        except FileNotFoundError:
            return {}

    def commits_df(self) -> DataFrame:
        """The commits as the table the graph and log operators read; all on one line named ``line``."""
        rows = [
            (c["commit_id"], "history", c["tree"], c["parents"], c["author"], c["author_ts"], c["author"], c["author_ts"], c["message"]) for c in self.commits().values()
        ]
        schema = "commit_id string, line string, tree string, parents array<string>, author_name string, author_ts long, committer_name string, committer_ts long, message string"
        return self.spark.createDataFrame(rows, schema)

    def ref_parse(self, name: str) -> str | None:
        """The full name of a ref: itself, or the only one that ends so among heads, else tags, else remotes."""
        names = self.refs()
        if name in names:
            return name
        for space in ("refs/heads/", "refs/tags/", "refs/remotes/"):
            hits = [n for n in names if n.startswith(space) and n.endswith("/" + name)]
            if len(hits) > 1:
                raise ValueError(f"{name} is ambiguous: {', '.join(sorted(hits))}")
            if hits:
                return hits[0]
        return None

    def branch_of(self, commit: str) -> str | None:
        """The branch whose head a commit is."""
        return next((n for n, c in sorted(self.refs("refs/heads/").items()) if c == commit), None)

    def resolve(self, spec: str) -> str:
        """The commit, tree or object a revision names. Raises ValueError for unknown and ambiguous ones."""
        r, names, known = revisions.parse(spec), self.refs(), self.commits()
        at = names.get(self.ref_parse(r.start) or "")
        while at in names:
            at = names[at]
        if at is None and r.start in known:
            at = r.start
        if at is None and revisions.is_id_prefix(r.start):
            hits = [c for c in known if c.startswith(r.start.lower())]
            hits = hits or sorted({c["tree"] for c in known.values() if c["tree"].startswith(r.start.lower())})
            if len(hits) > 1:
                raise ValueError(f"ambiguous: {r.start}")
            at = hits[0] if hits else None
        for kind, n in r.steps:
            if kind == "type":
                if at in known and n == "tree":
                    at = known[at]["tree"]
                elif n not in ("", "commit") or n == "commit" and at not in known:
                    at = None
                continue
            for hop in [int(n) - 1] if kind == "parent" else [0] * int(n):
                parents = known.get(at, {}).get("parents", [])
                at = at if hop < 0 else parents[hop] if hop < len(parents) else None
        if at is not None and r.path:
            node = self.node(r.path, at)
            at = node and node["object_id"]
        if at is None:
            raise ValueError(f"unknown revision: {spec}")
        return at

    def node(self, path: str, spec: str = "HEAD") -> dict | None:
        """The row of a feature or tree at a path of a revision."""
        parent, _, name = path.rpartition("/")
        row = self.nodes(spec).filter((F.col("parent_path") == parent) & (F.col("ref_name") == name)).first()
        return row and row.asDict()

    def kind_of(self, spec: str) -> str:
        """COMMIT, TREE or FEATURE."""
        at, known = self.resolve(spec), self.commits()
        if at in known:
            return "COMMIT"
        return "TREE" if any(c["tree"] == at for c in known.values()) or at in self.refs().values() else (self.node(spec.partition(":")[2], spec.partition(":")[0]) or {"ref_type": "TREE"})["ref_type"]

    # -- trees ----------------------------------------------------------------------------------------

    def tree_of(self, spec: str) -> str:
        if spec in (EMPTY, NULL_ID):
            return EMPTY
        if spec == "HEAD" and self.head is None:
            return EMPTY
        known = self.commits()
        at = spec if spec in known else self.resolve(spec)
        return known[at]["tree"] if at in known else at

    def nodes(self, spec: str = "HEAD") -> DataFrame:
        """The listing at a revision, or at WORK_HEAD or STAGE_HEAD."""
        tree = self.tree_of(spec)
        if tree == EMPTY:
            return self.spark.createDataFrame([], LISTING)
        return self.spark.read.schema(LISTING).parquet(self._file("trees", tree))

    def _store(self, listing: DataFrame) -> str:
        """Write a listing as a tree named by its content: an order-free sum of row hashes and the count."""
        tmp = self._file("trees", ".new-" + uuid.uuid4().hex)
        cols = [c.split()[0] for c in LISTING.split(", ")]
        listing.select(cols).repartition("parent_path").sortWithinPartitions(*PATH).write.parquet(tmp)
        back = self.spark.read.schema(LISTING).parquet(tmp)
        row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
        d = back.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(20,0)")).alias("s")).first()
        tree = EMPTY if d["n"] == 0 else hashlib.sha1(f"tree {d['n']} {d['s']}".encode()).hexdigest()
        if tree == EMPTY or os.path.exists(self._file("trees", tree)):
            shutil.rmtree(tmp)
        else:
            os.replace(tmp, self._file("trees", tree))
        return tree

    def objects(self) -> DataFrame:
        """``object_id object_text`` of every stored feature."""
        schema = "object_id string, object_text string"
        folder = self._file("objects")
        df = self.spark.read.schema(schema).parquet(folder) if os.path.exists(folder) else self.spark.createDataFrame([], schema)
        return df.groupBy("object_id").agg(F.first("object_text").alias("object_text"))

    def features(self, path: str, spec: str = "HEAD") -> DataFrame:
        """Features of a tree with their attributes: ``ref_name object_id attributes`` and bounds."""
        n = self.nodes(spec).filter((F.col("parent_path") == path) & (F.col("ref_type") == "FEATURE"))
        return n.join(self.objects(), "object_id", "left").withColumn("attributes", values.attributes("object_text"))

    # -- working tree and index -------------------------------------------------------------------------

    def insert(self, path: str, rows: DataFrame, fid: str, kinds: dict[str, str], geometry: str | None = None, replace: bool = False) -> None:
        """Put features into the working tree: ``rows`` with the column ``fid`` and one for each of ``kinds``.

        ``kinds`` maps columns to field types, in order. Of rows with the same fid one is kept, the greatest by
        content. Existing features are replaced; ``replace`` drops the tree's others.
        """
        self._fire("pre_insert", path=path)
        types = dict(rows.dtypes)
        attrs = F.array(*[
            F.struct(F.when(F.col(c).isNull(), "NULL").otherwise(k).alias("kind"), values.text_of(F.col(c), types[c]).alias("value")) for c, k in kinds.items()
        ])
        if geometry:
            rows = rows.withColumn("_points", wkt.coordinates(f"`{geometry}`"))
            box = wkt.box(F.col("_points"))
        else:
            box = [F.lit(None).cast("double").alias(n) for n in bounds.BOUNDS]
        made = rows.select(F.col(fid).cast("string").alias("ref_name"), values.render(attrs).alias("object_text"), *box).dropna(subset=["ref_name"])
        made = made.groupBy("ref_name").agg(F.max(F.struct("object_text", *bounds.BOUNDS)).alias("x")).select("ref_name", "x.*")
        made = made.withColumn("object_id", values.object_id("object_text"))
        made.select("object_id", "object_text").write.mode("append").parquet(self._file("objects"))
        new = made.select(F.lit(path).alias("parent_path"), "ref_name", F.lit("FEATURE").alias("ref_type"), "object_id", F.lit(None).cast("string").alias("metadata_id"), *bounds.BOUNDS)
        work = self.nodes("WORK_HEAD")
        other = work.filter(F.col("parent_path") != path) if replace else work.join(new.select(*PATH), PATH, "left_anti")
        trees = self.spark.createDataFrame([(*p.rpartition("/")[::2],) for p in _parts(path)], "parent_path string, ref_name string")
        missing = trees.join(work.filter("ref_type = 'TREE'"), PATH, "left_anti").select(
            *PATH, F.lit("TREE").alias("ref_type"), F.sha1(F.concat_ws("/", *PATH)).alias("object_id"), F.lit(None).cast("string").alias("metadata_id"),
            *[F.lit(None).cast("double").alias(n) for n in bounds.BOUNDS],
        )
        self.update_ref("WORK_HEAD", self._store(other.unionByName(new).unionByName(missing)))
        self._fire("post_insert", path=path)

    def delete(self, path: str, names: DataFrame | None = None) -> None:
        """Remove a tree with all below it, or only the features ``ref_name`` of it, from the working tree."""
        work = self.nodes("WORK_HEAD")
        if names is not None:
            left = work.join(names.select(F.lit(path).alias("parent_path"), "ref_name"), PATH, "left_anti")
        else:
            parent, _, name = path.rpartition("/")
            below = (F.col("parent_path") == path) | F.col("parent_path").startswith(path + "/")
            left = work.filter(~(below | ((F.col("parent_path") == parent) & (F.col("ref_name") == name))))
        self.update_ref("WORK_HEAD", self._store(left))

    def remove(self, path: str) -> None:
        """Remove a path from working tree and index."""
        self.delete(path)
        self.add(path)

    def add(self, path: str = "", update_only: bool = False) -> None:
        """Stage the working tree's changes at or below a path; ``update_only`` leaves new features out."""
        changes = self._below(diffs.diff(self.nodes("STAGE_HEAD"), self.nodes("WORK_HEAD"), trees=True), path)
        if update_only:
            changes = changes.filter("change_kind <> 'ADDED'")
        self.update_ref("STAGE_HEAD", self._store(merges.apply_changes(self.nodes("STAGE_HEAD"), changes)))

    @staticmethod
    def _below(changes: DataFrame, path: str) -> DataFrame:
        return diffs.filter_path(changes, path) if path else changes

    def diff(self, old: str = "STAGE_HEAD", new: str = "WORK_HEAD", path: str = "", change: str | None = None, trees: bool = False) -> DataFrame:
        """Differences between two revisions; none are looked for where both name one tree."""
        if self.tree_of(old) == self.tree_of(new):
            empty = self.spark.createDataFrame([], LISTING)
            return diffs.diff(empty, empty)
        return self._below(diffs.diff(self.nodes(old), self.nodes(new), change=change, trees=trees), path)

    def status(self) -> dict[str, int]:
        """How many staged and unstaged changes and conflicts there are."""
        return {
            "staged": self.diff("HEAD", "STAGE_HEAD").count(), "unstaged": self.diff("STAGE_HEAD", "WORK_HEAD").count(), "conflicts": self.open_conflicts().count(),
        }

    def clean(self, path: str = "") -> None:
        """Drop untracked features from the working tree."""
        new = self.diff("STAGE_HEAD", "WORK_HEAD", path, "ADDED")
        self.update_ref("WORK_HEAD", self._store(merges.apply_changes(self.nodes("WORK_HEAD"), merges.reversed_changes(new))))

    # -- commits ----------------------------------------------------------------------------------------

    def commit(
        self, message: str | None = None, author: str | None = None, when: int | None = None, all: bool = False, amend: bool = False, allow_empty: bool = False,
        parents: list[str] | None = None, paths: list[str] | None = None,
    ) -> str:
        """Commit the index; ``all`` stages everything first, ``paths`` commits only what is staged at or below them.

        An unchanged index is refused unless ``allow_empty``. Without a message, that of the merge in progress or (amending) the old one is used.
        """
        self._fire("pre_commit", message=message)
        if self.open_conflicts().limit(1).count():
            raise ConflictError("there are conflicts left")
        if all:
            for path in paths or [""]:
                self.add(path)
        tree, head, known = self.refs()["STAGE_HEAD"], self.head, self.commits()
        if paths:
            changes = diffs.diff(self.nodes("HEAD"), self.nodes("STAGE_HEAD"), trees=True)
            only = self._below(changes, paths[0])
            for path in paths[1:]:
                only = only.unionByName(self._below(changes, path))
            tree = self._store(merges.apply_changes(self.nodes("HEAD"), only.distinct()))
        merging = [c for c in (self.refs().get("MERGE_HEAD") or "").split(",") if c]
        if message is None:
            message = self.merge_message() or (known[head]["message"] if amend and head else None)
        if not message:
            raise ValueError("a commit needs a message")
        if parents is None:
            parents = known[head]["parents"] if amend else [x for x in (head, *merging) if x]
        before = known[head]["tree"] if head else EMPTY
        if tree == before and not (allow_empty or amend or merging or len(parents) > 1):
            raise ValueError("nothing to commit")
        who = author or self.config_get("user.name") or "unnamed"
        at = self._commit(tree, parents, who, int(time.time() * 1000) if when is None else when, message)
        self._move_head(at)
        self._end_merge()
        self._fire("post_commit", commit=at)
        return at

    def merge_message(self) -> str | None:
        """The message of the merge in progress."""
        return self._read("message.json", None)

    def _end_merge(self) -> None:
        self.update_ref("MERGE_HEAD", None)
        if self.merge_message() is not None:
            self._write("message.json", None)

    def _commit(self, tree: str, parents: list[str], author: str, when: int, message: str) -> str:
        c = {"tree": tree, "parents": parents, "author": author, "author_ts": when, "message": message}
        c["commit_id"] = hashlib.sha1(json.dumps(c, sort_keys=True).encode()).hexdigest()
        with self._locked(), open(self._file("commits.jsonl"), "a") as f:
            f.write(json.dumps(c) + "\n")
        return c["commit_id"]

    def _move_head(self, commit: str) -> None:
        self.update_ref(self.branch or "HEAD", commit)

    def _set_trees(self, tree: str) -> None:
        self.update_ref("WORK_HEAD", tree)
        self.update_ref("STAGE_HEAD", tree)

    def log(
        self, until: str = "HEAD", since: str | None = None, first_parent: bool = False, paths: list[str] | None = None, author: str | None = None,
        committer: str | None = None, after: int | None = None, before: int | None = None, topological: bool = False, skip: int = 0, limit: int | None = None,
    ) -> list[dict]:
        """Commits reached from ``until`` and not from ``since``, newest first or children before parents.

        ``author`` and ``committer`` are whole-string patterns, ``after`` and ``before`` bound the time, both included; ``paths`` keeps
        commits in which something at or below one of them differs from any parent. History is small next to the data: it is walked here.
        """
        known = self.commits()

        def reach(at: str | None) -> set[str]:
            out, todo = set(), [at] if at else []
            while todo:
                c = todo.pop()
                if c in known and c not in out:
                    out.add(c)
                    todo += known[c]["parents"][: 1 if first_parent else None]
            return out

        start = self.head if until == "HEAD" else self.resolve(until)
        got = reach(start) - (reach(self.resolve(since)) if since else set())
        out = sorted((known[c] for c in got), key=lambda c: (-c["author_ts"], c["commit_id"]))
        if topological:
            number: dict[str, int] = {}
            for c in known.values():  # parents were made before
                number[c["commit_id"]] = 1 + max((number.get(p, 0) for p in c["parents"]), default=0)
            out.sort(key=lambda c: -number[c["commit_id"]])
        for pattern in (author, committer):
            if pattern is not None:
                out = [c for c in out if re.fullmatch(pattern, c["author"])]
        out = [c for c in out if (after is None or c["author_ts"] >= after) and (before is None or c["author_ts"] <= before)]
        if paths:
            touched = self._touching(out, paths, known)
            out = [c for c in out if c["commit_id"] in touched]
        return out[skip:][:limit]

    def _touching(self, commits: list[dict], paths: list[str], known: dict[str, dict]) -> set[str]:
        """The commits that differ from a parent at or below the paths: digests of each tree's rows there, in one job."""
        trees = {known[x]["tree"] for c in commits for x in (c["commit_id"], *c["parents"]) if x in known} - {EMPTY}
        digests: dict[str, tuple] = {}
        if trees:
            rows = self.spark.read.schema(LISTING).parquet(*[self._file("trees", t) for t in sorted(trees)])
            where = F.lit(False)
            for p in paths:
                where = where | (pathing.full_path("parent_path", "ref_name") == p) | (F.col("parent_path") == p) | F.col("parent_path").startswith(p + "/")
            tree = F.regexp_extract(F.input_file_name(), "/trees/([^/]+)/", 1)
            h = F.xxhash64(*PATH, "ref_type", F.coalesce("object_id", F.lit("")), F.coalesce("metadata_id", F.lit("")))
            for r in rows.filter(where).groupBy(tree.alias("t")).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s")).collect():
                digests[r["t"]] = (r["n"], r["s"])
        of = lambda c: digests.get(known[c]["tree"]) if c in known else None
        return {c["commit_id"] for c in commits if any(of(p) != of(c["commit_id"]) for p in c["parents"] or [""])}

    def blame(self, path: str, spec: str = "HEAD") -> list[tuple[int, str | None, str]]:
        """``position, value, commit`` of every attribute of a feature: the commit that last set it, along first parents."""
        history = self.log(spec, first_parent=True, topological=True, paths=[path])
        trees = sorted({c["tree"] for c in history} - {EMPTY})
        if not trees or self.node(path, spec) is None:
            raise ValueError(f"no feature at {path}")
        parent, _, name = path.rpartition("/")
        rows = self.spark.read.schema(LISTING).parquet(*[self._file("trees", t) for t in trees])
        rows = rows.filter((F.col("parent_path") == parent) & (F.col("ref_name") == name) & (F.col("ref_type") == "FEATURE"))
        tree = F.regexp_extract(F.input_file_name(), "/trees/([^/]+)/", 1)
        texts = rows.select(tree.alias("t"), "object_id").join(self.objects(), "object_id", "left").select("t", values.attributes("object_text").alias("a"))
        of = {r["t"]: [(x["kind"], x["value"]) for x in r["a"] or []] for r in texts.collect()}
        now = of.get(history[0]["tree"], [])
        out = []
        for i, value in enumerate(now):
            at = history[0]["commit_id"]
            for c in history:
                had = of.get(c["tree"])
                if had is None or len(had) <= i or had[i] != value:
                    break
                at = c["commit_id"]
            out.append((i, value[1], at))
        return out

    def reachable(self, spec: str = "HEAD") -> DataFrame:
        """``id kind`` of everything a commit's history reaches: commits, root trees, and what their listings name."""
        c = self.log(spec)
        own = [(x["commit_id"], "COMMIT") for x in c] + [(t, "TREE") for t in sorted({x["tree"] for x in c} - {EMPTY})]
        out = self.spark.createDataFrame(own, "id string, kind string")
        trees = [self._file("trees", t) for _, t in enumerate(sorted({x["tree"] for x in c} - {EMPTY}))]
        if trees:
            named = self.spark.read.schema(LISTING).parquet(*trees)
            types = named.filter("metadata_id is not null").select(F.col("metadata_id").alias("id"), F.lit("FEATURETYPE").alias("kind"))
            out = out.unionByName(named.select(F.col("object_id").alias("id"), F.col("ref_type").alias("kind"))).unionByName(types)
        return out.distinct()

    def common_ancestor(self, a: str, b: str) -> str | None:
        """The lowest common ancestor; of several the newest."""
        known = self.commits()
        both = {c["commit_id"] for c in self.log(a)} & {c["commit_id"] for c in self.log(b)}
        above = {p for c in both for p in known[c]["parents"]}
        low = both - above
        return max(low, key=lambda c: (known[c]["author_ts"], c)) if low else None

    # -- branches, tags, checkout -------------------------------------------------------------------------

    def branch_create(self, name: str, at: str = "HEAD", checkout: bool = False, force: bool = False, orphan: bool = False) -> None:
        """A branch at a revision; an ``orphan`` one begins with the next commit, of what is staged now."""
        ref = "refs/heads/" + name
        if ref in self.refs() and not force:
            raise ValueError(f"{name} exists")
        if orphan:
            self.update_ref(ref, None)
            self.update_ref("HEAD", ref)
            return
        self.update_ref(ref, self.resolve(at))
        if checkout:
            self.checkout(name)

    def branch_delete(self, name: str) -> None:
        if self.branch == "refs/heads/" + name:
            raise ValueError("can't delete the current branch")
        self.update_ref("refs/heads/" + name, None)

    def branch_rename(self, old: str, new: str) -> None:
        a, b = "refs/heads/" + old, "refs/heads/" + new
        if b in self.refs():
            raise ValueError(f"{new} exists")
        self.update_ref(b, self.refs()[a])
        if self.branch == a:
            self.update_ref("HEAD", b)
        self.update_ref(a, None)

    def branches(self, remotes: bool = False) -> list[str]:
        """Names of the branches, or of the remotes' branches."""
        space = "refs/remotes/" if remotes else "refs/heads/"
        return sorted(k[len(space) :] for k in self.refs(space))

    def tag(self, name: str, at: str = "HEAD", message: str = "") -> None:
        if "refs/tags/" + name in self.refs():
            raise ValueError(f"{name} exists")
        tags = self._read("tags.json", {})
        tags[name] = {"commit_id": self.resolve(at), "message": message}
        self._write("tags.json", tags)
        self.update_ref("refs/tags/" + name, self.resolve(at))

    def tags(self) -> dict[str, dict]:
        return self._read("tags.json", {})

    def tag_remove(self, name: str) -> None:
        tags = self._read("tags.json", {})
        tags.pop(name)
        self._write("tags.json", tags)
        self.update_ref("refs/tags/" + name, None)

    def checkout(self, name: str, force: bool = False) -> None:
        """Switch to a branch, or to a commit with HEAD naming it; uncommitted changes stop that unless ``force``."""
        if not force and any(self.status().values()):
            raise ValueError("there are uncommitted changes")
        ref = "refs/heads/" + name
        at = self.resolve(name)
        self.update_ref("HEAD", ref if ref in self.refs() else at)
        self._set_trees(self.tree_of(at))

    def checkout_paths(self, path: str, at: str = "STAGE_HEAD") -> None:
        """Restore a path of the working tree from a revision."""
        changes = self._below(diffs.diff(self.nodes("WORK_HEAD"), self.nodes(at), trees=True), path)
        self.update_ref("WORK_HEAD", self._store(merges.apply_changes(self.nodes("WORK_HEAD"), changes)))

    def checkout_side(self, path: str, side: str) -> None:
        """Decide all conflicts at or below a path by ``ours`` or ``theirs``; index and working tree take that version's rows."""
        other = {"ours": "HEAD", "theirs": (self.refs().get("MERGE_HEAD") or "").split(",")[0]}[side]
        if not other:
            raise ValueError("no merge in progress")
        below = lambda d: d.filter((pathing.full_path("parent_path", "ref_name") == path) | pathing.is_below(pathing.full_path("parent_path", "ref_name"), path))
        mine = below(self.open_conflicts()).select(*PATH)
        work = self.nodes("WORK_HEAD").join(mine, PATH, "left_anti").unionByName(self.nodes(other).join(mine, PATH, "left_semi"))
        self._set_trees(self._store(work))
        self._keep_conflicts(self.open_conflicts().join(mine, PATH, "left_anti"))

    def reset_paths(self, paths: list[str], at: str = "HEAD") -> None:
        """Restore paths of the index from a revision."""
        for path in paths:
            changes = self._below(diffs.diff(self.nodes("STAGE_HEAD"), self.nodes(at), trees=True), path)
            self.update_ref("STAGE_HEAD", self._store(merges.apply_changes(self.nodes("STAGE_HEAD"), changes)))

    def reset(self, at: str = "HEAD", mode: str = "MIXED") -> None:
        """SOFT moves the branch, MIXED also the index, HARD also the working tree."""
        if mode not in ("SOFT", "MIXED", "HARD"):
            raise ValueError(f"unsupported mode {mode}")
        commit = self.resolve(at)
        self._move_head(commit)
        if mode != "SOFT":
            self.update_ref("STAGE_HEAD", self.tree_of(commit))
        if mode == "HARD":
            self.update_ref("WORK_HEAD", self.tree_of(commit))
            self._keep_conflicts(None)
            self._end_merge()

    # -- merging ------------------------------------------------------------------------------------------

    def open_conflicts(self) -> DataFrame:
        """``parent_path ref_name ancestor ours theirs`` of every undecided path."""
        at = self._read("conflicts.json", "")
        if isinstance(at, list):  # as earlier versions stored them
            return self.spark.createDataFrame([tuple(c[k] for k in (*PATH, "ancestor", "ours", "theirs")) for c in at], CONFLICTS)
        return self.spark.read.schema(CONFLICTS).parquet(self._file("conflicts", at)) if at else self.spark.createDataFrame([], CONFLICTS)

    def conflicts(self) -> list[dict]:
        """All of :meth:`open_conflicts` on the driver; for many, use the table."""
        return [r.asDict() for r in self.open_conflicts().collect()]

    def _keep_conflicts(self, open_: DataFrame | None) -> None:
        """Replace the stored conflicts."""
        before, name = self._read("conflicts.json", ""), uuid.uuid4().hex
        n = 0
        if open_ is not None:
            open_.write.parquet(self._file("conflicts", name))
            n = self.spark.read.schema(CONFLICTS).parquet(self._file("conflicts", name)).count()
        self._write("conflicts.json", name if n else "")
        for old in [before, "" if n else name]:
            if old and isinstance(old, str):
                shutil.rmtree(self._file("conflicts", old), ignore_errors=True)

    def resolve_conflict(self, parent_path: str, ref_name: str, object_id: str | None) -> None:
        """Decide a conflict by the object the path is to have, or null to remove it."""
        work = self.nodes("WORK_HEAD").filter(~((F.col("parent_path") == parent_path) & (F.col("ref_name") == ref_name)))
        if object_id is not None:
            new = self.spark.createDataFrame([(parent_path, ref_name, "FEATURE", object_id, None, None, None, None, None)], LISTING)
            work = work.unionByName(new)
        self._set_trees(self._store(work))
        here = F.col("parent_path").eqNullSafe(F.lit(parent_path)) & F.col("ref_name").eqNullSafe(F.lit(ref_name))
        self._keep_conflicts(self.open_conflicts().filter(~here))

    def _merge_trees(self, ancestor: DataFrame, ours: DataFrame, theirs: DataFrame, prefer: str | None) -> tuple[DataFrame, int, DataFrame]:
        """The merged listing, the number of conflicts that ``prefer`` (ours or theirs) doesn't settle, and their table.

        Trees are merged as rows of their own: new and removed ones, other feature types, and a tree that one side
        removed while the other changed something below it, which is a conflict.
        """
        classes = materialize(merges.classify(ancestor, ours, theirs, trees=True))
        merged = materialize(merges.merge_attributes(classes, self.objects()))
        fine = merged.filter("not conflicting").withColumn("object_id", values.object_id("merged_text"))
        fine.select("object_id", F.col("merged_text").alias("object_text")).write.mode("append").parquet(self._file("objects"))
        open_ = classes.filter("merge_class in ('both', 'conflict')").join(fine.select(*PATH), PATH, "left_anti")
        wanted = classes.filter("merge_class = 'theirs'").select(*PATH)
        if prefer == "theirs":
            wanted = wanted.unionByName(open_.select(*PATH))
        out = ours.join(wanted, PATH, "left_anti").unionByName(theirs.join(wanted, PATH, "left_semi").select(ours.columns))
        # a conflicting tree that theirs removed keeps its rows on our side, and one that we removed stays removed
        repl = fine.join(self._boxes(fine), "object_id").select(*PATH, F.col("object_id").alias("_new"), *[F.col("_" + b) for b in bounds.BOUNDS])
        out = out.join(repl, PATH, "left").select(
            *PATH, "ref_type", F.coalesce("_new", "object_id").alias("object_id"), "metadata_id",
            *[F.when(F.col("_new").isNotNull(), F.col("_" + b)).otherwise(F.col(b)).alias(b) for b in bounds.BOUNDS],
        )
        open_ = materialize(open_.select(*PATH, "ancestor", "ours", "theirs"))
        return out, 0 if prefer else open_.count(), open_

    @staticmethod
    def _boxes(merged: DataFrame) -> DataFrame:
        """``object_id`` and the bounds of merged features, with an underscore before their names."""
        shapes = F.filter(values.attributes("merged_text"), lambda a: a["kind"].isin(merges.GEOMETRIES))
        text = merged.select("object_id", F.array_join(F.transform(shapes, lambda a: a["value"]), " ").alias("_text")).dropDuplicates(["object_id"])
        return text.withColumn("_points", wkt.coordinates("_text")).select("object_id", *[c.alias("_" + b) for c, b in zip(wkt.box(F.col("_points")), bounds.BOUNDS)])

    def merge(self, *others: str, message: str | None = None, prefer: str | None = None, commit: bool = True) -> str:
        """Merge revisions into the current branch; ``prefer`` (``ours`` or ``theirs``) settles conflicts.

        A branch that is only behind is moved forward. Conflicts of a merge with one revision are stored and raise
        :class:`ConflictError`; with several revisions, conflicts raise it and nothing is changed.
        """
        them = [self.resolve(o) for o in others]
        self._fire("pre_merge", commits=them)
        head, new = self.head, []
        for t in them:
            if head is None or self.common_ancestor("HEAD", t) != t:
                new.append(t)
        if not new:
            return head
        if len(new) == 1 and (head is None or self.common_ancestor("HEAD", new[0]) == head) and commit:
            self._move_head(new[0])
            self._set_trees(self.tree_of(new[0]))
            return new[0]
        tree = self.nodes("HEAD")
        for t in new:
            merged, left, open_ = self._merge_trees(self.nodes(self.common_ancestor("HEAD", t) or EMPTY), tree, self.nodes(t), prefer)
            if left and len(new) > 1:
                raise ConflictError(f"{left} conflicts with {t}; merge one at a time")
            tree = materialize(merged)
        text = message or "Merge " + ", ".join(others)
        self.update_ref("ORIG_HEAD", head)
        self._set_trees(self._store(tree))
        self.update_ref("MERGE_HEAD", ",".join(new))
        self._write("message.json", text)
        if left:
            self._keep_conflicts(open_)
            raise ConflictError(f"{left} conflicts")
        return self.commit(text) if commit else self.head

    def merge_abort(self) -> None:
        """Back to before the merge in progress."""
        if "MERGE_HEAD" not in self.refs():
            raise ValueError("no merge in progress")
        self.reset("HEAD", "HARD")

    def check_merge(self, *others: str) -> bool:
        """Whether merging the revisions would meet conflicts or have to merge features; nothing is changed."""
        tree = self.nodes("HEAD")
        for o in others:
            them = self.resolve(o)
            classes = materialize(merges.classify(self.nodes(self.common_ancestor("HEAD", them) or EMPTY), tree, self.nodes(them), trees=True))
            if classes.filter("merge_class in ('both', 'conflict')").limit(1).count():
                return True
            wanted = classes.filter("merge_class = 'theirs'").select(*PATH)
            tree = tree.join(wanted, PATH, "left_anti").unionByName(self.nodes(them).join(wanted, PATH, "left_semi").select(tree.columns))
        return False

    def commit_conflicts(self, spec: str) -> DataFrame:
        """The conflicts that applying a commit to HEAD would meet: ``parent_path ref_name ancestor ours theirs``."""
        c = self.commits()[self.resolve(spec)]
        _, _, open_ = self._merge_trees(self.nodes(c["parents"][0] if c["parents"] else EMPTY), self.nodes("HEAD"), self.nodes(c["commit_id"]), None)
        return open_

    # -- sequences of replayed commits ----------------------------------------------------------------------

    def _replay(self, change_from: str, change_to: str, message: str, author: str, commit: bool = True) -> str | None:
        """Apply the difference of two revisions to HEAD."""
        tree, left, open_ = self._merge_trees(self.nodes(change_from), self.nodes("HEAD"), self.nodes(change_to), None)
        self._set_trees(self._store(tree))
        if left:
            self._keep_conflicts(open_)
            self.update_ref("MERGE_HEAD", None)
            raise ConflictError(f"{left} conflicts")
        return self.commit(message, author, allow_empty=True) if commit else None

    def _first(self, c: dict) -> str:
        return c["parents"][0] if c["parents"] else EMPTY

    def _begin(self, kind: str, steps: list[tuple[str, str, str, str]], commit: bool = True) -> str:
        if self._read("sequence.json", None):
            raise ValueError("another sequence is in progress")
        self._write("sequence.json", {"kind": kind, "orig": self.head, "todo": steps, "now": None, "commit": commit})
        return self._go_on()

    def _go_on(self) -> str:
        while (q := self._read("sequence.json", None)) and q["todo"]:
            q["now"], q["todo"] = q["todo"][0], q["todo"][1:]
            self._write("sequence.json", q)
            self._replay(*q["now"], q["commit"])
        self._write("sequence.json", None)
        return self.head

    def _sequence(self) -> dict:
        q = self._read("sequence.json", None)
        if not q:
            raise ValueError("no rebase, revert or pick in progress")
        return q

    def continue_(self) -> str:
        """Go on with a rebase, revert or pick whose conflicts are decided."""
        q = self._sequence()
        if self.open_conflicts().limit(1).count():
            raise ConflictError("there are conflicts left")
        if q["now"] and q["commit"]:
            self.commit(q["now"][2], q["now"][3], allow_empty=True)
        return self._go_on()

    def skip(self) -> str:
        """Leave out the commit that conflicts and go on."""
        self._sequence()
        self.reset("HEAD", "HARD")
        return self._go_on()

    def abort(self) -> str:
        """Back to before the rebase, revert or pick in progress."""
        self.reset(self._sequence()["orig"], "HARD")
        self._write("sequence.json", None)
        return self.head

    def cherry_pick(self, *specs: str) -> str:
        """Apply what commits changed from their first parents."""
        picked = [self.commits()[self.resolve(x)] for x in specs]
        return self._begin("pick", [(self._first(c), c["commit_id"], c["message"], c["author"]) for c in picked])

    def revert(self, *specs: str, commit: bool = True) -> str:
        """Undo what commits changed from their first parents."""
        undone = [self.commits()[self.resolve(x)] for x in specs]
        return self._begin("revert", [(c["commit_id"], self._first(c), f"Revert {c['message']}", c["author"]) for c in undone], commit)

    def rebase(self, upstream: str, onto: str | None = None, squash: str | None = None) -> str:
        """Replay the own commits since the common ancestor on top of another revision; ``squash`` makes one of them with that message.

        A conflict stops it with the commits still to come kept: :meth:`continue_`, :meth:`skip` or :meth:`abort`.
        """
        them = self.resolve(upstream)
        own = [c for c in reversed(self.log("HEAD", since=them, first_parent=True, topological=True)) if len(c["parents"]) < 2]
        orig = self.head
        steps = [(self._first(c), c["commit_id"], c["message"], c["author"]) for c in own]
        if squash and own:
            steps = [(self._first(own[0]), own[-1]["commit_id"], squash, own[-1]["author"])]
        self.reset(self.resolve(onto) if onto else them, "HARD")
        if self._read("sequence.json", None):
            raise ValueError("another sequence is in progress")
        self._write("sequence.json", {"kind": "rebase", "orig": orig, "todo": steps, "now": None, "commit": True})
        return self._go_on()

    def squash(self, since: str, message: str, until: str = "HEAD") -> str:
        """Replace the commits after ``since`` up to ``until`` by one; later ones are made anew on top of it.

        Refused if another of them than the last is a parent of a commit outside, or a later one of a commit not among them.
        """
        base, last, known = self.resolve(since), self.resolve(until), self.commits()
        own = {c["commit_id"] for c in self.log(last, since=base)}
        later = [c for c in reversed(self.log("HEAD", since=last, topological=True))]
        gone = own | {c["commit_id"] for c in later}
        held = {c["commit_id"]: c for name in self.refs("refs/") for c in self.log(name)}
        if any(p in gone for k, c in held.items() if k not in gone for p in c["parents"]) or any(p in own - {last} for c in later for p in c["parents"]):
            raise ValueError("a branch begins inside the commits to squash")
        outside = [p for k in own for p in known[k]["parents"] if p not in own and p != base]
        at = self._commit(known[last]["tree"], [base, *dict.fromkeys(outside)], known[last]["author"], known[last]["author_ts"], message)
        new = {last: at}
        for c in later:
            new[c["commit_id"]] = self._commit(c["tree"], [new.get(p, p) for p in c["parents"]], c["author"], c["author_ts"], c["message"])
        self._move_head(new[self.head])
        return self.head

    # -- patches ------------------------------------------------------------------------------------------

    def create_patch(self, old: str, new: str, path: str = "") -> DataFrame:
        return self.diff(old, new, path)

    def apply_patch(self, patch: DataFrame, partial: bool = False, reverse: bool = False) -> DataFrame:
        """Apply a patch to the working tree and return its rejected rows; with some, nothing is done unless ``partial``."""
        patch = merges.reversed_changes(patch) if reverse else patch
        verdicts = patches.verify_patch(self.nodes("WORK_HEAD"), patch)
        rejected = verdicts.filter("not applicable")
        if not partial and rejected.limit(1).count():
            raise ValueError("the patch doesn't apply")
        self.update_ref("WORK_HEAD", self._store(patches.apply_patch(self.nodes("WORK_HEAD"), patch)))
        return rejected

    # -- transactions and other repositories ----------------------------------------------------------------

    def transaction_begin(self) -> Repo:
        """This repository with names of its own: what it does to branches, index and working tree shows nowhere else until it ends."""
        key = uuid.uuid4().hex
        os.makedirs(self._file("transactions"), exist_ok=True)
        with self._locked():
            names = self._read(self._names, {})
        self._write(f"transactions/{key}.begun.json", names)
        self._write(f"transactions/{key}.json", names)
        out = Repo(self.spark, self.path, key)
        out.hooks = self.hooks
        return out

    def transaction_end(self, cancel: bool = False, rebase: bool = False) -> None:
        """Bring a transaction's names into the repository, or drop them.

        A branch that others moved meanwhile is merged with theirs (or rebased on it) first; if that
        conflicts, the transaction goes on and :class:`ConflictError` is raised.
        """
        if not self.transaction_id:
            raise ValueError("no transaction")
        main, begun = Repo(self.spark, self.path), self._read(f"transactions/{self.transaction_id}.begun.json", {})
        if not cancel:
            for name in sorted({*begun, *self.refs()} - {"HEAD", "WORK_HEAD", "STAGE_HEAD"}):
                mine, old, now = self.refs().get(name), begun.get(name), main.refs().get(name)
                if mine == old:
                    continue
                if now != old and now is not None and mine is not None and name.startswith("refs/heads/"):
                    if self.branch != name:
                        self.checkout(name[11:], force=True)
                    mine = self.rebase(now) if rebase else self.merge(now)
                elif now != old:
                    raise ValueError(f"{name} has changed")
                main.update_ref(name, mine, now)
            for name in ("HEAD", "WORK_HEAD", "STAGE_HEAD"):
                if self.refs()[name] != begun[name] or main.branch == self.branch and main.refs()[name] == begun[name]:
                    main.update_ref(name, self.refs()[name])
        for f in (f"{self.transaction_id}.json", f"{self.transaction_id}.begun.json"):
            os.unlink(self._file("transactions", f))

    @contextlib.contextmanager
    def transaction(self, rebase: bool = False) -> Iterator[Repo]:
        """The block's changes, made through the repository it is given, are kept if it ends well and dropped if it raises."""
        t = self.transaction_begin()
        try:
            yield t
        except BaseException:
            t.transaction_end(cancel=True)
            raise
        t.transaction_end(rebase=rebase)

    def remote_add(self, name: str, path: str) -> None:
        self.config_set(f"remote.{name}", os.path.abspath(path))

    def remotes(self) -> dict[str, str]:
        return {k[7:]: v for k, v in self.config_list().items() if k.startswith("remote.")}

    def remote_remove(self, name: str) -> None:
        self.config_set(f"remote.{name}", None)

    @classmethod
    def clone(cls, spark: SparkSession, source: str, path: str, depth: int | None = None, branch: str | None = None) -> Repo:
        """A copy of another repository, with its current branch (or ``branch``) checked out; ``depth`` copies only so many commits of each history."""
        out = cls.init(spark, path)
        out.remote_add("origin", source)
        out.fetch("origin", depth=depth)
        name = "refs/heads/" + branch if branch else cls(spark, source).branch or "refs/heads/master"
        at = out.refs().get("refs/remotes/origin/" + name[11:])
        out.update_ref("HEAD", name)
        if at:
            out.update_ref(name, at)
            out._set_trees(out.tree_of(at))
        return out

    def _copy_from(self, other: Repo, heads: list[str], depth: int | None = None) -> None:
        mine, known, new = self.commits(), other.commits(), {}
        level = [h for h in heads if h in known]
        for _ in range(depth if depth is not None else len(known) + 1):
            level = [c for c in dict.fromkeys(level) if c in known and c not in new]
            if not level:
                break
            new |= {c: known[c] for c in level if c not in mine}
            level = [p for c in level for p in known[c]["parents"]]
        for tree in {c["tree"] for c in new.values()} - {EMPTY}:
            if not os.path.exists(self._file("trees", tree)):
                tmp = self._file("trees", ".new-" + uuid.uuid4().hex)
                shutil.copytree(other._file("trees", tree), tmp)
                os.replace(tmp, self._file("trees", tree))
        if os.path.exists(other._file("objects")) and new:
            have = self.objects().select("object_id")
            other.objects().join(have, "object_id", "left_anti").write.mode("append").parquet(self._file("objects"))
        order = [c for c in known.values() if c["commit_id"] in new]
        with self._locked(), open(self._file("commits.jsonl"), "a") as f:
            f.writelines(json.dumps(c) + "\n" for c in order)

    @property
    def is_shallow(self) -> bool:
        """Whether commits are here whose parents aren't."""
        known = self.commits()
        return any(p not in known for c in known.values() for p in c["parents"])

    def ls_remote(self, name: str = "origin") -> dict[str, str]:
        """The branches and tags of a remote, without fetching anything."""
        other = Repo(self.spark, self.remotes().get(name, name))
        return {k: v for k, v in other.refs("refs/").items() if k.startswith(("refs/heads/", "refs/tags/"))}

    @staticmethod
    def _mapped(spec: str, names: dict[str, str]) -> dict[str, str]:
        """Names on the other side of ``[+]source:target``, ``*`` standing for the same part on both."""
        source, _, target = spec.lstrip("+").partition(":")
        if "*" in source:
            a, z = source.split("*", 1)
            return {target.replace("*", n[len(a) : len(n) - len(z) or None]): v for n, v in names.items() if n.startswith(a) and n.endswith(z)}
        full = next((n for n in (source, "refs/heads/" + source, "refs/tags/" + source) if n in names), None)
        return {target or full: names[full]} if full else {}

    def fetch(self, name: str = "origin", prune: bool = False, specs: list[str] | None = None, depth: int | None = None) -> dict[str, tuple[str | None, str | None]]:
        """Bring a remote's branches and what they reach; the names that changed with their old and new commits.

        ``specs`` are ``[+]source:target``, by default all branches to ``refs/remotes/<name>/``. ``depth`` brings only so many commits of each history.
        """
        other = Repo(self.spark, self.remotes()[name])
        there = other.refs("refs/")
        theirs: dict[str, str] = {}
        for spec in specs or [f"+refs/heads/*:refs/remotes/{name}/*"]:
            theirs |= self._mapped(spec, there)
        self._copy_from(other, list(theirs.values()), depth)
        before = self.refs("refs/")
        out = {k: (before.get(k), v) for k, v in theirs.items() if before.get(k) != v}
        if prune:
            out |= {k: (v, None) for k, v in self.refs(f"refs/remotes/{name}/").items() if k not in theirs}
        for k, (_, new) in out.items():
            self.update_ref(k, new)
        return out

    def pull(self, name: str = "origin", rebase: bool = False, branch: str | None = None) -> str:
        """Fetch, then merge or rebase on the remote's branch of the same name, or ``branch``."""
        self.fetch(name)
        ref = f"refs/remotes/{name}/{branch or self.branch[11:]}"
        return self.rebase(ref) if rebase else self.merge(ref)

    def push(self, name: str = "origin", spec: str | None = None, all: bool = False) -> str | None:
        """Send the current branch, that of ``local:remote`` (nothing before the colon deletes) or all; refused if the remote has commits ours lacks."""
        other = Repo(self.spark, self.remotes()[name])
        if all:
            for b in self.branches():
                self.push(name, b)
            return self.head
        local, _, remote = (spec or self.branch).partition(":")
        full = lambda n: n if n.startswith("refs/") else "refs/heads/" + n
        target = full(remote or local)
        if not local:
            other.update_ref(target, None)
            return None
        at, theirs = self.resolve(local), other.refs().get(target)
        if theirs is not None and theirs not in {c["commit_id"] for c in self.log(at)}:
            raise ValueError("the remote has other commits; pull first")
        other._copy_from(self, [at])
        other.update_ref(target, at, theirs)
        if other.branch == target:
            other._set_trees(other.tree_of(at))
        return at


def _parts(path: str) -> list[str]:
    parts = path.split("/") if path else []
    return ["/".join(parts[: i + 1]) for i in range(len(parts))]
