"""Command line: build an index from Parquet, look into it, search it, compare policies."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from . import __version__
from .functions.policy import PRESETS, load_settings, preset
from .operators import index as ix
from .operators import search as se
from .operators import store
from .session import get_spark
from .sources import seeds


def _settings(name: str):
    return preset(name) if name in PRESETS else load_settings(name)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("tesela")
    parser.add_argument("--version", action="version", version=__version__)
    sub = parser.add_subparsers(dest="command", required=True)
    build = sub.add_parser("indexar", help="build an index")
    build.add_argument("coleccion", help="Parquet with doc_id, hash_url, texto")
    build.add_argument("indice")
    build.add_argument("-c", "--politica", default="estandar", help="policy name or configuration file")
    look = sub.add_parser("inspeccionar", help="totals, checks, or one term")
    look.add_argument("indice")
    look.add_argument("--termino")
    ask = sub.add_parser("buscar", help="ranked search")
    ask.add_argument("indice")
    ask.add_argument("consulta")
    ask.add_argument("-k", type=int, default=10)
    bench = sub.add_parser("benchmark", help="compare the policies")
    bench.add_argument("coleccion")
    check = sub.add_parser("verificar", help="seeds, allowed hosts and the store")
    check.add_argument("semillas", help="file of seed addresses")
    check.add_argument("almacen", help="folder of the store's tables, made if missing")
    a = parser.parse_args(argv)
    spark = get_spark()
    try:
        if a.command == "verificar":
            found = seeds.read_seeds(spark, a.semillas)
            hosts = sorted(r.host for r in found.select("host").distinct().collect())  # a configuration of bounded size
            store.bootstrap(spark, a.almacen).show(truncate=False)
            row = store.summary(spark.read.parquet(f"{a.almacen}/documentos"), spark.read.parquet(f"{a.almacen}/bitacora_recorrido")).first()
            print(f"seeds: {found.count()}", *[f"  {h}" for h in hosts], f"documents: {row.documentos}, bytes: {row.bytes}, log: {row.bitacora}", sep="\n")
            return 0
        if a.command == "indexar":
            s = _settings(a.politica)
            ix.write_index(ix.build_index(spark.read.parquet(a.coleccion), s.normalizacion, s.modelo, keep=True), a.indice)
        elif a.command == "inspeccionar":
            index = ix.read_index(spark, a.indice)
            if a.termino:
                se.term_report(index, a.termino).show(truncate=False)
            else:
                index.meta.show(vertical=True)
                bad = ix.verify(index).where(F.col("problemas") > 0)
                bad.show()
                return int(bad.limit(1).count() > 0)
        elif a.command == "buscar":
            index = ix.read_index(spark, a.indice)
            question = spark.createDataFrame([(1, a.consulta)], "consulta_id int, consulta string")
            rows = se.search(question, index, a.k).orderBy("puesto").collect()
            for r in rows:
                print(f"{r.puesto}\t{r.doc_id}\t{r.similitud:.6f}\t{r.hash_url}")
            if not rows:
                print("similar terms:", *[r.termino for r in se.suggestions(se.query_tokens(question, index), index).orderBy("puesto").collect()])
        else:
            for name in PRESETS:
                ix.metrics(ix.build_index(spark.read.parquet(a.coleccion), PRESETS[name], keep=True), name).show(vertical=True)
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
