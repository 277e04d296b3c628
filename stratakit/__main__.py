"""Command line.

Over a stored tree (STORE is the folder of its versions, ROOT the tree):

    python -m stratakit init STORE ROOT
    python -m stratakit status STORE ROOT
    python -m stratakit create STORE ROOT --name NAME
    python -m stratakit list STORE ROOT
    python -m stratakit rename STORE ROOT --checkpoint ID --name NAME
    python -m stratakit delete STORE ROOT --checkpoint ID
    python -m stratakit changes STORE ROOT --checkpoint ID [--metadata]
    python -m stratakit preview STORE ROOT --checkpoint ID [--path PATH ...]
    python -m stratakit apply STORE ROOT --checkpoint ID --plan PLAN [--path PATH ...]
    python -m stratakit verify STORE ROOT [--checkpoint ID] [--quick]
    python -m stratakit index STORE ROOT
    python -m stratakit garbage STORE ROOT [--plan PLAN]

``preview`` prints the plan's id, which ``apply`` asks for; with --path it is about these paths and what depends on
them. ``garbage`` lists what may go and its plan's id; with that id it deletes.

Over Parquet tables:

    python -m stratakit queries
    python -m stratakit run NAME DATA [--out DIR]
    python -m stratakit diff ENTRIES WORKING [--metadata] [--incomplete]
    python -m stratakit restore-plan ENTRIES WORKING [--out DIR]
    python -m stratakit scan ROOT [--hash] [--out DIR]
    python -m stratakit refs ENTRIES
    python -m stratakit gc OBJECTS REFS
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from stratakit.operators import diff, gc, plan, refs
from stratakit.session import local_session
from stratakit.sinks.repository import Repository
from stratakit.sources import scan

STORED = ("init", "status", "create", "list", "rename", "delete", "changes", "preview", "apply", "verify", "index", "garbage")
TABLES = {"queries": (), "run": ("name", "data"), "diff": ("entries", "working"), "restore-plan": ("entries", "working"), "scan": ("root",), "refs": ("entries",), "gc": ("objects", "refs")}


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="stratakit", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name, inputs in (TABLES | dict.fromkeys(STORED, ("store", "root"))).items():
        verb = verbs.add_parser(name)
        for x in inputs:
            verb.add_argument(x)
        verb.add_argument("--out", help="a folder for the result as Parquet, instead of the first rows")
        for flag in ("--metadata", "--incomplete", "--hash", "--quick"):
            verb.add_argument(flag, action="store_true")
        if name in STORED:
            verb.add_argument("--checkpoint", required=name in ("rename", "delete", "changes", "preview", "apply"))
            if name in ("create", "rename"):
                verb.add_argument("--name", required=True)
            verb.add_argument("--plan", required=name == "apply")
            verb.add_argument("--path", action="append")
    return parser.parse_args(argv)


def stored(spark, a: argparse.Namespace) -> DataFrame | None:
    """The verbs over a stored tree; what they show, if anything."""
    repository = Repository(spark, a.store, a.root)
    if a.verb == "init":
        repository.init()
    elif a.verb == "create":
        print(repository.create(a.name))
    elif a.verb == "rename":
        repository.rename(a.checkpoint, a.name)
    elif a.verb == "delete":
        repository.delete(a.checkpoint)
    elif a.verb == "preview":
        found = repository.preview(a.checkpoint, a.path)
        plan.plan_summary(found).show()
        print(plan.plan_id(found).first()[0])
        return found
    elif a.verb == "apply":
        return repository.apply(a.checkpoint, a.plan, a.path)
    elif a.verb == "changes":
        found = repository.diff(a.checkpoint, a.metadata)
        diff.diff_summary(found).show()
        return found
    elif a.verb == "verify":
        return repository.verify(a.checkpoint, a.quick)
    elif a.verb == "garbage":
        if a.plan is not None:
            print(repository.collect_garbage(a.plan))
            return None
        found = repository.garbage()
        print(repository.garbage_plan(found))
        return found
    else:
        return {"status": repository.status, "list": repository.versions, "index": repository.index}[a.verb]()
    return None


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    if a.verb == "queries":
        from stratakit.plans.library import QUERIES

        print("\n".join(sorted(QUERIES)))
        return
    spark = local_session()
    read = spark.read.parquet
    if a.verb in STORED:
        result = stored(spark, a)
        if result is None:
            return
    elif a.verb == "run":
        from stratakit.plans.library import QUERIES

        result = QUERIES[a.name](spark, a.data)
    elif a.verb == "diff":
        result = (diff.metadata_diff if a.metadata else diff.content_diff)(read(a.entries), read(a.working), not a.incomplete)
        diff.diff_summary(result).show()
    elif a.verb == "restore-plan":
        result = plan.restore_plan(read(a.entries), read(a.working))
        plan.plan_summary(result).show()
    elif a.verb == "scan":
        result = scan.scan_tree(spark, a.root, a.hash)
    elif a.verb == "refs":
        result = refs.object_refs(read(a.entries))
    else:
        result = gc.unreferenced(read(a.objects), read(a.refs), ["object_id"])
    result.write.parquet(a.out) if a.out else result.show(20, truncate=70)


if __name__ == "__main__":
    main()
