"""Saving and loading a session's tables, exports under a guarded folder, SQL dumps."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame

from larkspur.plans.catalog import TableMeta
from larkspur.plans.session import Session, ddl
from larkspur.sources.files import Files
from larkspur.sources.text import write_csv


def guarded(root: str, relative: str) -> str:
    """A path below ``root``, a local folder or a URI; absolute paths, ``..`` and (locally) links that lead out are errors."""
    parts = PurePosixPath(relative).parts
    if not parts or relative.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
        raise PermissionError(f"path leaves the export folder: {relative}")
    if "://" in root or root.startswith("file:"):
        return f"{root.rstrip('/')}/{'/'.join(parts)}"
    base = Path(root).resolve()
    full = (base / relative).resolve()
    if not full.is_relative_to(base):
        raise PermissionError(f"path leaves the export folder: {relative}")
    return str(full)


def save(session: Session, path: str) -> None:
    """Write all tables as parquet with a metadata file: to a staging folder first, then swapped in; the last state stays as ``.bak``.

    ``path`` may lie on any file system that Spark writes to; on a cluster it must be one that all executors share.
    """
    files, staging, backup = Files(session.spark), path + ".tmp", path + ".bak"
    files.delete(staging)
    for name, df in session.state.tables.items():
        # Sorted files by the ordered indexes, so that a scan with a condition on them skips most row groups.
        ordered = [c for _, c, kind in session.state.meta[name].indexes if kind == "btree" and c in df.columns]
        (df.sortWithinPartitions(*ordered) if ordered else df).write.parquet(f"{staging}/{name}")
    meta = {"tables": {n: m.describe() for n, m in session.state.meta.items()}, "views": session.state.views, "sequences": session.state.sequences}
    files.write(f"{staging}/_meta.json", json.dumps(meta, indent=1))
    if files.exists(path):
        files.delete(backup)
        files.move(path, backup)
    files.move(staging, path)


def load(session: Session, path: str) -> None:
    """Read a saved state, or its ``.bak`` if it cannot be read; all or nothing."""
    files, errors = Files(session.spark), []
    for folder in (path, path + ".bak"):
        try:
            meta = json.loads(files.read(f"{folder}/_meta.json"))
            metas = {n: TableMeta.restore(session.spark, d) for n, d in meta["tables"].items()}
            # An empty table has no part files, only its schema in the metadata.
            frames = {n: session.spark.read.schema(m.schema()).parquet(f"{folder}/{n}") for n, m in metas.items()}
        except (OSError, ValueError, KeyError) as e:
            errors.append(e)
            continue
        for n, df in frames.items():
            session.register(n, df, metas[n])
        for n, sql in meta["views"].items():
            session.sql(f"CREATE OR REPLACE VIEW {n} AS {sql}")
        session.state.sequences.update(meta["sequences"])
        return
    raise OSError(f"no readable state at {path}: {errors}")


def export(df: DataFrame, root: str, relative: str, kind: str) -> str:
    """Write ``df`` below ``root`` as ``csv``, ``json`` or ``parquet``; returns the path."""
    path = guarded(root, relative)
    if kind == "csv":
        write_csv(df, path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown export format: {kind}")
    return path


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, list):
        return "ARRAY[" + ", ".join(map(_literal, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def dump(session: Session) -> Iterator[str]:
    """Statements that build the session's tables and views anew, rows streamed partition by partition."""
    for name, meta in session.state.meta.items():
        yield ddl(name, meta) + ";"
        for index, column, kind in meta.indexes:
            yield f"CREATE INDEX {index} ON {name} USING {kind.upper()} ({column});"
        for row in session.table(name).toLocalIterator():
            yield f"INSERT INTO {name} VALUES ({', '.join(map(_literal, row))});"
    for name, sql in session.state.views.items():
        yield f"CREATE VIEW {name} AS {sql};"


def copy_tables(source: Session, target: Session, names: list[str] | None = None) -> None:
    """Overwrite tables of another session with this one's, all or nothing."""
    before = target.state.copy()
    try:
        for name in names or list(source.state.tables):
            target.register(name, source.table(name), source.state.meta[name])
    except Exception:
        target._restore(before)
        raise
