"""python -m tessera COMMAND: validate CONFIG | generate CONFIG STORE FOLDER KIND [SPEC...] | load CONFIG STORE FOLDER POD LINES [TYPE...] |
search CONFIG STORE FOLDER SPEC INDEX FIELD TEXT | namespaces LINES | quads CONFIG STORE FOLDER POD OUT

Runs in the session that spark-submit or the settings of the machine give.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tessera.operators.store import Store
from tessera.plans.config import Config
from tessera.sources import rdf


def main(args: list[str]) -> int:
    if not args or args[0] not in ("validate", "generate", "load", "search", "namespaces", "quads"):
        print(__doc__)
        return 2
    command, *rest = args
    if command == "validate":
        config = Config.of(rest[0], "max")
        for store in config.stores.values():
            print(store.name, {kind: sorted(found) for kind, found in store.specifications.items()})
        return 0
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if command == "namespaces":
        from tessera.functions.uri import Namespaces

        rows = rdf.namespace_report(rdf.parse_lines(spark.read.text(rest[0])), Namespaces({}))
        rdf.suggest_prefixes(rows, Namespaces({})).show(1000, False)
        return 0
    store = Store(spark, Config.of(rest[0]), rest[1], rest[2])
    if command == "generate":
        for name in rest[4:] or store.config.specifications[rest[3]]:
            store.generate(rest[3], name)
    elif command == "load":
        store.load(rest[3], spark.read.text(rest[4]), rest[5:] or None)
    elif command == "quads":
        rdf.to_lines(store.pod(rest[3]).triples(), store.ns, quads=True, ascii_only=True).write.text(rest[4])
    else:
        store.composites["search"].search(store, rest[6], rest[3], [rest[4]], [rest[5]]).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
