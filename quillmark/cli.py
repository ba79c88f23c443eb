"""Command line: index a directory, or query an index."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quillmark import __version__, settings
from quillmark.operators.registry import Registry
from quillmark.serve import Request, Server
from quillmark.workspace import FOLDER, Workspace, build


def init_directory(path: str, spark: SparkSession | None = None, **options) -> dict:
    return build(spark or SparkSession.builder.getOrCreate(), path, **options)


def open_directory(path: str, spark: SparkSession | None = None) -> Workspace:
    workspace = Workspace(spark or SparkSession.builder.getOrCreate(), f"{path.rstrip('/')}/{FOLDER}")
    if not workspace.exists():
        raise FileNotFoundError(f"no index below {path}")
    return workspace


def query_directory(path: str, query: str, spark: SparkSession | None = None, **options) -> str:
    return Server(open_directory(path, spark)).query(Request(query, **options)).content


def start_server(path: str, spark: SparkSession | None = None, **options) -> Server:
    return Server(open_directory(path, spark), **options)


def asked(prompt: str, default: str = "", read=input) -> str:
    """An answer that is not empty; the default stands for an empty one."""
    while True:
        if answer := read(prompt).strip() or default:
            return answer


def package_info() -> dict:
    return {"name": "quillmark", "version": __version__, "description": "Spark-native document and code search"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmark", description="Index and search documentation and code with Spark.")
    p.add_argument("path")
    p.add_argument("--query", help="query the index instead of building it")
    p.add_argument("--force", action="store_true", help="build again over an index")
    p.add_argument("--config")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--no-embeddings", action="store_true")
    p.add_argument("--parallel-workers", type=int, help="shuffle partitions of the build")
    p.add_argument("--log-file")
    p.add_argument("--ask", action="store_true", help="ask for a name and a description that are not given")
    p.add_argument("--workspace-name")
    p.add_argument("--workspace-description", default="")
    p.add_argument("--registry", help="folder of the central registry")
    p.add_argument("--no-central-registry", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    chosen = settings.load(args.config) if args.config else settings.Settings()
    settings.configure_logging("DEBUG" if args.verbose else chosen.logging.level, args.log_file)
    spark = SparkSession.builder.appName("quillmark").getOrCreate()
    if args.parallel_workers:
        spark.conf.set("spark.sql.shuffle.partitions", args.parallel_workers)
    if args.query:
        print(query_directory(args.path, args.query, spark))
        return 0
    if Workspace(spark, f"{args.path.rstrip('/')}/{FOLDER}").exists() and not args.force:
        print(f"{args.path} is indexed; use --force", file=sys.stderr)
        return 1
    chosen.update(enable_embeddings=chosen.indexing.enable_embeddings and not args.no_embeddings)
    if args.ask:
        folder = args.path.rstrip("/").rpartition("/")[2]
        args.workspace_name = args.workspace_name or asked(f"Workspace name ({folder}): ", folder)
        args.workspace_description = args.workspace_description or asked("Workspace description: ")
    registry = Registry(spark, args.registry) if args.registry and not args.no_central_registry else None
    print(init_directory(args.path, spark, settings=chosen, registry=registry, name=args.workspace_name, description=args.workspace_description, force=args.force))
    return 0


if __name__ == "__main__":
    sys.exit(main())
