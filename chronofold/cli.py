"""The command line: ``python -m chronofold [--repo FOLDER] COMMAND ...``, a thin layer over :class:`~chronofold.repo.Repo`."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import values
from .functions.ids import NULL_ID
from .functions.paths import full_path
from .functions.times import parse_time
from .operators import diff as diffs
from .operators import listing, merge, osm, osm_repo, patch
from .repo import ConflictError, Repo
from .sources import geojson, tables

COMMANDS: dict[str, tuple[Callable, list]] = {}


def command(name: str, *arguments):
    """Register a function ``(repo, args)`` under one or two words; arguments are ``(names, options)``."""

    def keep(f: Callable) -> Callable:
        COMMANDS[name] = (f, list(arguments))
        return f

    return keep


def arg(*names: str, **how):
    return names, how


FLAG = {"action": "store_true"}


def session() -> SparkSession:
    spark = SparkSession.builder.appName("chronofold").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def say(*lines: str) -> None:
    for x in lines:
        print(x)


def _when(ts: int) -> str:
    return dt.datetime.fromtimestamp(ts / 1000, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def _changes(d: DataFrame, brief: bool = False) -> None:
    for r in d.select("change_kind", full_path("parent_path", "ref_name").alias("path"), "old_object_id", "new_object_id").orderBy("path").toLocalIterator():
        ids = "" if brief else f"  {(r['old_object_id'] or NULL_ID)[:8]} -> {(r['new_object_id'] or NULL_ID)[:8]}"
        say(f"{r['change_kind'][0]}  {r['path']}{ids}")


# -- plumbing -------------------------------------------------------------------------------------------


@command("cat", arg("object"))
def cat(repo: Repo, a) -> None:
    at, known = repo.resolve(a.object), repo.commits()
    if at in known:
        c = known[at]
        say("COMMIT", f"tree\t{c['tree']}", f"parents\t{' '.join(c['parents'])}", f"author\t{c['author']}\t{c['author_ts']}", f"message\t{c['message']}")
        return
    row = repo.objects().filter(F.col("object_id") == at).first()
    if row:
        say(row["object_text"])
        return
    say("TREE")
    for r in repo.nodes(at).orderBy("parent_path", "ref_name").toLocalIterator():
        say(f"{r['ref_type']}\t{r['parent_path']}\t{r['ref_name']}\t{r['object_id']}\t{r['metadata_id'] or NULL_ID}\t{r['minx']};{r['maxx']};{r['miny']};{r['maxy']}")


@command("diff-tree", arg("old"), arg("new", nargs="?", default="WORK_HEAD"), arg("path", nargs="?", default=""), arg("--tree-stats", **FLAG))
def diff_tree(repo: Repo, a) -> None:
    d = repo.diff(a.old, a.new, a.path, trees=a.tree_stats)
    _changes(d)


@command("insert", arg("-f", "--file", required=True), arg("path"), arg("--kinds", required=True, help="column:KIND,..."), arg("--fid", default="fid"), arg("--geometry"))
def insert(repo: Repo, a) -> None:
    kinds = dict(k.split(":") for k in a.kinds.split(","))
    rows = repo.spark.read.parquet(a.file) if a.file.endswith(".parquet") else repo.spark.read.csv(a.file, header=True)
    repo.insert(a.path, rows, a.fid, kinds, a.geometry)


def _listed(repo: Repo, a, spec: str) -> None:
    where, _, path = spec.partition(":")
    how = ("DEPTHFIRST" if a.recurse else "CHILDREN") if not a.trees else ("DEPTHFIRST_ONLY_TREES" if a.recurse else "TREES_ONLY")
    for r in listing.ls_tree(repo.nodes(where or "HEAD"), path, how).orderBy("path").toLocalIterator():
        say(f"{r['ref_type'].lower()} {r['object_id'][:8]} {r['path']}" if a.verbose else r["path"])


LIST = [arg("-r", "--recurse", **FLAG), arg("-d", "--trees", **FLAG), arg("-v", "--verbose", **FLAG), arg("spec", nargs="?", default="HEAD")]


@command("ls-tree", *LIST)
def ls_tree(repo: Repo, a) -> None:
    _listed(repo, a, a.spec)


@command("ls", *LIST)
def ls(repo: Repo, a) -> None:
    _listed(repo, a, a.spec if ":" in a.spec or a.spec == "HEAD" else "WORK_HEAD:" + a.spec)


@command("merge-base", arg("a"), arg("b"))
def merge_base(repo: Repo, a) -> None:
    say(repo.common_ancestor(a.a, a.b) or "no common ancestor")


@command("rebuild-graph")
def rebuild_graph(repo: Repo, a) -> None:
    from .operators.graph import commit_edges

    say(f"{commit_edges(repo.commits_df()).count()} links")


@command("rev-list", arg("revisions", nargs="*"), arg("-n", type=int, dest="limit"), arg("--skip", type=int, default=0), arg("--first-parent", **FLAG), arg("-p", "--path", action="append"), arg("--changed", **FLAG))
def rev_list(repo: Repo, a) -> None:
    since, until = (a.revisions[0].split("..") if a.revisions and ".." in a.revisions[0] else (None, a.revisions[0] if a.revisions else "HEAD"))
    for c in repo.log(until or "HEAD", since, a.first_parent, paths=a.path, skip=a.skip, limit=a.limit):
        say(f"commit {c['commit_id']}", f"tree {c['tree']}", f"parent {' '.join(c['parents'])}", f"author {c['author']} {c['author_ts']}", f"message {c['message']}")
        if a.changed:
            _changes(repo.diff(c["parents"][0] if c["parents"] else "empty", c["commit_id"]), True)
        say("")


@command("rev-parse", arg("specs", nargs="*"), arg("--is-inside", **FLAG), arg("--resolve-folder", **FLAG))
def rev_parse(repo: Repo, a) -> None:
    if a.resolve_folder:
        say(repo.path)
    if a.is_inside:
        say("true")
    say(*[repo.resolve(x) for x in a.specs])


@command("show-ref")
def show_ref(repo: Repo, a) -> None:
    say(*[f"{v} {k}" for k, v in sorted(repo.refs("refs/").items())])


@command("verify-patch", arg("file"), arg("--reverse", **FLAG))
def verify_patch(repo: Repo, a) -> None:
    p = read_patch(repo, a.file)
    bad = patch.verify_patch(repo.nodes("WORK_HEAD"), merge.reversed_changes(p) if a.reverse else p).filter("not applicable")
    if not bad.limit(1).count():
        say("the patch applies")
        return
    for r in bad.orderBy("parent_path", "ref_name").toLocalIterator():
        say(f"{r['change_kind']} {r['parent_path']}/{r['ref_name']}: {r['verdict']}")


@command("walk-graph", arg("spec", nargs="?", default="HEAD"), arg("-v", "--verbose", **FLAG))
def walk_graph(repo: Repo, a) -> None:
    for r in repo.reachable(a.spec).orderBy("kind", "id").toLocalIterator():
        say(f"{r['id']}: {r['kind']}" if a.verbose else r["id"])


# -- work, index, commits ---------------------------------------------------------------------------------


@command("init", arg("folder", nargs="?", default="."))
def init(repo: None, a) -> None:
    say(f"repository at {Repo.init(session(), a.folder).path}")


@command("add", arg("path", nargs="?", default=""), arg("-n", "--dry-run", **FLAG), arg("-u", "--update", **FLAG))
def add(repo: Repo, a) -> None:
    if a.dry_run:
        _changes(repo.diff(path=a.path, trees=True), True)
    else:
        repo.add(a.path, a.update)


@command("rm", arg("paths", nargs="+"), arg("-r", "--recursive", **FLAG))
def rm(repo: Repo, a) -> None:
    for p in a.paths:
        node = repo.node(p, "WORK_HEAD")
        if node is None:
            raise ValueError(f"nothing at {p}")
        if node["ref_type"] == "TREE" and not a.recursive:
            raise ValueError(f"{p} is a tree; use -r")
        repo.remove(p)


@command("commit", arg("-m", dest="message"), arg("-t", dest="when", type=int), arg("--amend", **FLAG), arg("--all", **FLAG), arg("--allow-empty", **FLAG), arg("paths", nargs="*"))
def commit(repo: Repo, a) -> None:
    at = repo.commit(a.message, when=a.when, all=a.all, amend=a.amend, allow_empty=a.allow_empty, paths=a.paths)
    say(f"[{at[:8]}] {repo.commits()[at]['message']}")


@command("status")
def status(repo: Repo, a) -> None:
    n = repo.status()
    say(f"On {repo.branch or 'commit ' + str(repo.head)}", *[f"{n[k]} {k}" for k in ("staged", "unstaged", "conflicts")])
    for title, old, new in (("staged", "HEAD", "STAGE_HEAD"), ("unstaged", "STAGE_HEAD", "WORK_HEAD")):
        if n[title]:
            say(f"# {title}:")
            _changes(repo.diff(old, new), True)


@command("clean", arg("path", nargs="?", default=""), arg("-n", "--dry-run", **FLAG))
def clean(repo: Repo, a) -> None:
    if a.dry_run:
        _changes(repo.diff(path=a.path, change="ADDED"), True)
    else:
        repo.clean(a.path)


@command("reset", arg("commit", nargs="?", default="HEAD"), arg("--soft", **FLAG), arg("--mixed", **FLAG), arg("--hard", **FLAG), arg("-p", "--path", action="append"))
def reset(repo: Repo, a) -> None:
    if a.path:
        repo.reset_paths(a.path, a.commit)
    else:
        repo.reset(a.commit, "SOFT" if a.soft else "HARD" if a.hard else "MIXED")


@command("checkout", arg("what", nargs="?", default="STAGE_HEAD"), arg("-f", "--force", **FLAG), arg("-p", "--path", action="append"), arg("--ours", **FLAG), arg("--theirs", **FLAG))
def checkout(repo: Repo, a) -> None:
    for p in a.path or []:
        if a.ours or a.theirs:
            repo.checkout_side(p, "ours" if a.ours else "theirs")
        else:
            repo.checkout_paths(p, a.what)
    if not a.path:
        repo.checkout(a.what, a.force)


# -- history ----------------------------------------------------------------------------------------------


@command(
    "log", arg("range", nargs="?", default="HEAD"), arg("-n", type=int, dest="limit"), arg("--skip", type=int, default=0), arg("--oneline", **FLAG), arg("--since"), arg("--until"), arg("--author"), arg("--committer"),
    arg("--topo-order", **FLAG), arg("--first-parent", **FLAG), arg("-p", "--path", action="append"), arg("--summary", **FLAG), arg("--stats", **FLAG), arg("--names-only", **FLAG), arg("--csv", **FLAG),
)
def log(repo: Repo, a) -> None:
    since, until = a.range.split("..") if ".." in a.range else (None, a.range)
    after, before = (x and parse_time(x) for x in (a.since, a.until))
    rows = repo.log(until or "HEAD", since, a.first_parent, a.path, a.author, a.committer, after, before, a.topo_order, a.skip, a.limit)
    if a.csv:
        say("ChangeType,FeatureId,CommitId,Parents,Author,Time,Message")
    for c in rows:
        change = lambda: repo.diff(c["parents"][0] if c["parents"] else "empty", c["commit_id"], (a.path or [""])[0])  # noqa: B023, E731
        if a.csv:
            for r in change().select("change_kind", full_path("parent_path", "ref_name").alias("p")).orderBy("p").toLocalIterator():
                say(",".join(csv_cell(x) for x in (r["change_kind"], r["p"], c["commit_id"], " ".join(c["parents"]), c["author"], _when(c["author_ts"]), c["message"])))
        elif a.oneline:
            say(f"{c['commit_id'][:8]} {c['message'].splitlines()[0]}")
        else:
            say(f"Commit:  {c['commit_id']}", f"Author:  {c['author']}", f"Date:    {_when(c['author_ts'])}", f"Subject: {c['message']}", "")
            if a.summary or a.names_only:
                _changes(change(), a.names_only)
            if a.stats:
                r = diffs.count_changes(change()).first()
                say(f"{r['features_added']} added, {r['features_modified']} modified, {r['features_removed']} removed")


def csv_cell(x: str) -> str:
    """A cell of a CSV file, in quotes where it must be."""
    return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\r\n') else x


@command("show", arg("specs", nargs="*", default=["HEAD"]))
def show(repo: Repo, a) -> None:
    for x in a.specs:
        kind = repo.kind_of(x)
        if kind == "COMMIT":
            c = repo.commits()[repo.resolve(x)]
            say(f"Commit:  {c['commit_id']}", f"Author:  {c['author']}", f"Date:    {_when(c['author_ts'])}", f"Message: {c['message']}")
        elif kind == "FEATURE":
            row = repo.objects().filter(F.col("object_id") == repo.resolve(x)).select(values.attributes("object_text").alias("a")).first()
            say(f"Feature: {x}", *[f"{v['pos']} ({v['kind']}): {v['value']}" for v in row["a"]])
        else:
            where, _, path = x.partition(":")
            n = listing.ls_tree(repo.nodes(where), path, "DEPTHFIRST_ONLY_FEATURES").count()
            say(f"Tree: {x}", f"Size: {n}")


@command("blame", arg("path"), arg("--no-values", **FLAG))
def blame(repo: Repo, a) -> None:
    known = repo.commits()
    for pos, value, at in repo.blame(a.path):
        say(f"{pos}: {at[:8]} {known[at]['author']} {_when(known[at]['author_ts'])}" + ("" if a.no_values else f" {value}"))


@command(
    "diff", arg("specs", nargs="*"), arg("-p", "--path", default=""), arg("--cached", **FLAG), arg("--summary", **FLAG), arg("--count", **FLAG), arg("--bounds", **FLAG), arg("--nogeom", **FLAG),
)
def diff(repo: Repo, a) -> None:
    old, new = [*a.specs, *([] if len(a.specs) > 1 else ["STAGE_HEAD" if a.cached else "WORK_HEAD"])] if a.specs else ("HEAD", "STAGE_HEAD") if a.cached else ("STAGE_HEAD", "WORK_HEAD")
    d = repo.diff(old, new, a.path)
    if a.count:
        r = diffs.count_changes(d).first()
        say(f"Features changed: total: {r['features_added'] + r['features_modified'] + r['features_removed']}, added: {r['features_added']}, modified: {r['features_modified']}, removed: {r['features_removed']}")
    elif a.bounds:
        r = diffs.diff_bounds(d).first()
        for side in ("old", "new", "both"):
            say(f"{side}: {r[side + '_minx']},{r[side + '_miny']},{r[side + '_maxx']},{r[side + '_maxy']}")
    else:
        _changes(d)
        if not a.summary:
            for r in diffs.attribute_diff(d.filter("change_kind = 'MODIFIED'"), repo.objects(), []).orderBy("parent_path", "ref_name", "pos").toLocalIterator():
                if not (a.nogeom and r["new_kind"] in merge.GEOMETRIES):
                    say(f"{r['parent_path']}/{r['ref_name']} {r['pos']}: {r['old_value']} -> {r['new_value']}")


# -- branches, merging ------------------------------------------------------------------------------------


@command("branch", arg("name", nargs="?"), arg("start", nargs="?", default="HEAD"), arg("-c", "--checkout", **FLAG), arg("-d", "--delete", **FLAG), arg("-f", "--force", **FLAG), arg("-a", "--all", **FLAG), arg("-r", "--remotes", **FLAG), arg("--rename"), arg("--orphan", **FLAG), arg("-v", "--verbose", **FLAG))
def branch(repo: Repo, a) -> None:
    if a.rename:
        repo.branch_rename(a.name or repo.branch[11:], a.rename)
    elif a.delete:
        repo.branch_delete(a.name)
    elif a.name:
        repo.branch_create(a.name, a.start, a.checkout, a.force, a.orphan)
    else:
        spaces = (["refs/heads/"] if not a.remotes or a.all else []) + (["refs/remotes/"] if a.remotes or a.all else [])
        for space in spaces:
            for n, c in sorted(repo.refs(space).items()):
                say(f"{'*' if n == repo.branch else ' '} {n[len('refs/') if space == 'refs/remotes/' else len(space):]}" + (f" {c[:8]} {repo.commits()[c]['message']}" if a.verbose else ""))


@command("tag", arg("name", nargs="?"), arg("commit", nargs="?", default="HEAD"), arg("-m", dest="message", default=""), arg("-d", "--delete", **FLAG))
def tag(repo: Repo, a) -> None:
    if a.delete:
        repo.tag_remove(a.name)
    elif a.name:
        repo.tag(a.name, a.commit, a.message)
    else:
        say(*sorted(repo.tags()))


@command("merge", arg("commits", nargs="*"), arg("-m", dest="message"), arg("--ours", **FLAG), arg("--theirs", **FLAG), arg("--no-commit", **FLAG), arg("--abort", **FLAG))
def merge_(repo: Repo, a) -> None:
    if a.abort:
        repo.merge_abort()
    else:
        say(repo.merge(*a.commits, message=a.message, prefer="ours" if a.ours else "theirs" if a.theirs else None, commit=not a.no_commit))


@command("conflicts", arg("paths", nargs="*"), arg("--diff", **FLAG), arg("--ids-only", **FLAG))
def conflicts(repo: Repo, a) -> None:
    c = repo.open_conflicts()
    if a.paths:
        c = c.filter(full_path("parent_path", "ref_name").isin(a.paths))
    texts = {}
    if a.diff:
        texts = {r["object_id"]: r["object_text"] for r in repo.objects().join(c.select(F.explode(F.array("ancestor", "ours", "theirs")).alias("object_id")).distinct(), "object_id", "left_semi").toLocalIterator()}
    for r in c.select(full_path("parent_path", "ref_name").alias("path"), "ancestor", "ours", "theirs").orderBy("path").toLocalIterator():
        say("\t".join([r["path"], *[(r[k] or NULL_ID) for k in ("ancestor", "ours", "theirs")]]) if not a.ids_only else r["path"])
        if a.diff:
            say(*[f"{k}: {texts.get(r[k], '')!r}" for k in ("ancestor", "ours", "theirs")])


SEQUENCE = [arg("--continue", dest="go_on", **FLAG), arg("--skip", **FLAG), arg("--abort", **FLAG)]


def _step(repo: Repo, a) -> bool:
    call = repo.continue_ if a.go_on else repo.skip if a.skip else repo.abort if a.abort else None
    if call:
        say(call())
    return call is not None


@command("rebase", *SEQUENCE, arg("upstream", nargs="?"), arg("--onto"), arg("--squash"))
def rebase(repo: Repo, a) -> None:
    if not _step(repo, a):
        say(repo.rebase(a.upstream, a.onto, a.squash))


@command("revert", *SEQUENCE, arg("commits", nargs="*"), arg("--no-commit", **FLAG))
def revert(repo: Repo, a) -> None:
    if not _step(repo, a):
        say(repo.revert(*a.commits, commit=not a.no_commit))


@command("cherry-pick", *SEQUENCE, arg("commits", nargs="*"))
def cherry_pick(repo: Repo, a) -> None:
    if not _step(repo, a):
        say(repo.cherry_pick(*a.commits))


@command("squash", arg("since"), arg("until", nargs="?", default="HEAD"), arg("-m", dest="message", required=True))
def squash(repo: Repo, a) -> None:
    say(repo.squash(a.since, a.message, a.until))


# -- patches ------------------------------------------------------------------------------------------------


def read_patch(repo: Repo, path: str) -> DataFrame:
    return repo.spark.read.parquet(path)


@command("format-patch", arg("specs", nargs="*"), arg("-f", "--file", required=True), arg("-p", "--path", default=""), arg("--cached", **FLAG))
def format_patch(repo: Repo, a) -> None:
    old, new = a.specs if len(a.specs) == 2 else ("HEAD", "STAGE_HEAD") if a.cached else ("STAGE_HEAD", "WORK_HEAD")
    repo.create_patch(old, new, a.path).write.mode("overwrite").parquet(a.file)


@command("apply", arg("file"), arg("--reverse", **FLAG), arg("--reject", **FLAG), arg("--check", **FLAG), arg("--summary", **FLAG))
def apply(repo: Repo, a) -> None:
    p = read_patch(repo, a.file)
    if a.summary:
        _changes(p, True)
    elif a.check:
        verify_patch(repo, a)
    else:
        say(f"{repo.apply_patch(p, partial=a.reject, reverse=a.reverse).count()} rejected")


# -- settings and other repositories ------------------------------------------------------------------------


@command("config", arg("name", nargs="?"), arg("value", nargs="?"), arg("--global", dest="everywhere", **FLAG), arg("--unset", **FLAG), arg("--remove-section", **FLAG), arg("-l", "--list", **FLAG))
def config(repo: Repo, a) -> None:
    if a.list:
        say(*[f"{k}={v}" for k, v in sorted(repo.config_list(a.everywhere).items())])
    elif a.remove_section:
        repo.config_remove_section(a.name, a.everywhere)
    elif a.unset or a.value is not None:
        repo.config_set(a.name, None if a.unset else a.value, a.everywhere)
    else:
        say(repo.config_get(a.name, everywhere=a.everywhere or None) or "")


@command("remote add", arg("name"), arg("url"))
def remote_add(repo: Repo, a) -> None:
    repo.remote_add(a.name, a.url)


@command("remote list", arg("-v", "--verbose", **FLAG))
def remote_list(repo: Repo, a) -> None:
    say(*[f"{k} {v}" if a.verbose else k for k, v in sorted(repo.remotes().items())])


@command("remote rm", arg("name"))
def remote_rm(repo: Repo, a) -> None:
    repo.remote_remove(a.name)


@command("clone", arg("source"), arg("folder"), arg("-b", "--branch"), arg("--depth", type=int))
def clone(repo: None, a) -> None:
    say(f"repository at {Repo.clone(session(), a.source, a.folder, a.depth, a.branch).path}")


@command("fetch", arg("remote", nargs="?", default="origin"), arg("specs", nargs="*"), arg("--prune", **FLAG), arg("--depth", type=int), arg("--all", **FLAG))
def fetch(repo: Repo, a) -> None:
    for name in sorted(repo.remotes()) if a.all else [a.remote]:
        say(*[f"{k} {(x or NULL_ID)[:8]} -> {(y or NULL_ID)[:8]}" for k, (x, y) in sorted(repo.fetch(name, a.prune, a.specs or None, a.depth).items())])


@command("pull", arg("remote", nargs="?", default="origin"), arg("branch", nargs="?"), arg("--rebase", **FLAG))
def pull(repo: Repo, a) -> None:
    say(repo.pull(a.remote, a.rebase, a.branch))


@command("push", arg("remote", nargs="?", default="origin"), arg("specs", nargs="*"), arg("--all", **FLAG))
def push(repo: Repo, a) -> None:
    for spec in a.specs or [None]:
        say(repo.push(a.remote, spec, a.all) or "deleted")


@command("version")
def version(repo: None, a) -> None:
    say(__version__)


@command("help", arg("topic", nargs="*"))
def help_(repo: None, a) -> None:
    if a.topic:
        parser().parse_args([*a.topic, "--help"])
    say(*sorted(COMMANDS))


# -- files and databases ------------------------------------------------------------------------------------


def _fields(repo: Repo, path: str, spec: str, kinds: str) -> DataFrame:
    fields = [tuple(k.split(":")) for k in kinds.split(",")]
    return tables.export_features(repo.features(path, spec), fields, "alter")


@command("geojson import", arg("file"), arg("path"), arg("--schema", required=True, help="Spark schema of the properties"), arg("--kinds", required=True), arg("--replace", **FLAG))
def geojson_import(repo: Repo, a) -> None:
    d = geojson.read_geojson(repo.spark, a.file, a.schema).withColumn("fid", F.coalesce("fid", F.uuid()))
    repo.insert(a.path, d, "fid", dict(k.split(":") for k in a.kinds.split(",")) | {"geom": "GEOMETRY"}, "geom", a.replace)


@command("geojson export", arg("path"), arg("file"), arg("--kinds", required=True), arg("--geometry", default="geom"), arg("--at", default="HEAD"))
def geojson_export(repo: Repo, a) -> None:
    geojson.write_geojson(_fields(repo, a.path, a.at, a.kinds), a.file, "fid", a.geometry)


CONNECT = [arg("--database", required=True), arg("--host", default="localhost"), arg("--port", type=int), arg("--user"), arg("--password")]


def _options(kind: str, a) -> dict[str, str]:
    more = {k: v for k, v in (("user", a.user), ("password", a.password)) if v}
    return tables.jdbc_options(kind, a.database, a.host, a.port, **more)


def _database(name: str, kind: str) -> None:
    @command(f"{name} list", *CONNECT)
    def list_(repo: Repo, a) -> None:
        say(*[r[0] for r in tables.list_tables(repo.spark, kind, _options(kind, a)).toLocalIterator()])

    @command(f"{name} describe", *CONNECT, arg("table"))
    def describe(repo: Repo, a) -> None:
        say(*[f"{k}: {v}" for k, v in tables.describe(tables.read_jdbc(repo.spark, a.table, _options(kind, a))).items()])

    @command(f"{name} import", *CONNECT, arg("table"), arg("--path"), arg("--fid", required=True), arg("--kinds", required=True), arg("--geometry"), arg("--replace", **FLAG))
    def import_(repo: Repo, a) -> None:
        d = tables.read_jdbc(repo.spark, a.table, _options(kind, a))
        repo.insert(a.path or a.table, d, a.fid, dict(k.split(":") for k in a.kinds.split(",")), a.geometry, a.replace)

    @command(f"{name} export", *CONNECT, arg("path"), arg("table"), arg("--kinds", required=True), arg("--overwrite", **FLAG), arg("--at", default="HEAD"))
    def export(repo: Repo, a) -> None:
        tables.write_jdbc(_fields(repo, a.path, a.at, a.kinds), a.table, _options(kind, a), a.overwrite, 8)

    if name != "pg" and name != "sl":
        return

    @command(f"osm export-{name}", *CONNECT, arg("mapping"), arg("--overwrite", **FLAG))
    def osm_export(repo: Repo, a) -> None:
        with open(a.mapping) as f:
            for table, rows in osm_repo.mapped_export(repo, f.read()).items():
                tables.write_jdbc(rows, table, _options(kind, a), a.overwrite, 8)


for _name, _kind in (("pg", "postgis"), ("sl", "spatialite"), ("oracle", "oracle"), ("sqlserver", "sqlserver")):
    _database(_name, _kind)


# -- map data -------------------------------------------------------------------------------------------------


def _text(path: str | None) -> str | None:
    if path is None:
        return None
    with open(path) as f:
        return f.read()


@command("osm import", arg("file"), arg("--add", **FLAG), arg("--mapping"), arg("--no-raw", **FLAG), arg("-m", dest="message"))
def osm_import(repo: Repo, a) -> None:
    say(json.dumps(osm_repo.import_file(repo, a.file, a.message, a.add, _text(a.mapping), not a.no_raw)))


@command("osm map", arg("file"), arg("-m", dest="message"))
def osm_map(repo: Repo, a) -> None:
    say(*osm_repo.apply_mapping(repo, _text(a.file), a.message))


@command("osm unmap", arg("path"), arg("-m", dest="message"))
def osm_unmap(repo: Repo, a) -> None:
    say(f"{osm_repo.unmap(repo, a.path, a.message)} changed")


@command("osm apply-diff", arg("file"))
def osm_apply_diff(repo: Repo, a) -> None:
    osm_repo.apply_changes(repo, a.file)


@command("osm create-changeset", arg("old", nargs="?", default="HEAD~1"), arg("new", nargs="?", default="HEAD"), arg("-f", "--file", required=True))
def osm_create_changeset(repo: Repo, a) -> None:
    c = osm.change_set(repo.diff(a.old, a.new))
    line = F.concat(F.lit("<"), "action", F.lit("><"), "kind", F.lit(' id="'), "id", F.lit('"/></'), "action", F.lit(">"))
    c.select(line.alias("value")).write.mode("overwrite").text(a.file)


@command("osm import-history", arg("folder"), arg("--from", dest="first", type=int, default=1), arg("--to", dest="last", type=int))
def osm_import_history(repo: Repo, a) -> None:
    say(f"{osm_repo.import_history(repo, a.folder, a.first, a.last)} commits")


@command("osm export", arg("file"), arg("at", nargs="?", default="HEAD"))
def osm_export(repo: Repo, a) -> None:
    osm_repo.export(repo, a.at, a.file)


# -- entry ----------------------------------------------------------------------------------------------------

#: Commands that need no repository.
ALONE = {"init", "clone", "version", "help"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("chronofold", description="Versioned feature tables.")
    top.add_argument("--repo", default=".", help="folder in or below a repository")
    top.add_argument("--version", action="version", version=__version__)
    subs = top.add_subparsers(dest="command", required=True)
    groups: dict[str, argparse._SubParsersAction] = {}
    for name, (call, arguments) in COMMANDS.items():
        first, _, second = name.partition(" ")
        if second:
            if first not in groups:
                groups[first] = subs.add_parser(first).add_subparsers(dest="sub", required=True)
            p = groups[first].add_parser(second)
        else:
            p = subs.add_parser(first)
        for names, how in arguments:
            p.add_argument(*names, **how)
        p.set_defaults(call=call, full=name)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.full in ALONE:
            a.call(None, a)
        else:
            at = Repo.find(a.repo)
            if at is None:
                raise ValueError(f"no repository at or above {a.repo}")
            a.call(Repo(session(), at), a)
    except (ValueError, KeyError, ConflictError, FileNotFoundError) as x:
        print(f"error: {x}", file=sys.stderr)
        return 1
    return 0
