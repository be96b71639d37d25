"""Configuration as a typed tree: defaults under a user's values, dotted paths, values from text. Driver side."""

from __future__ import annotations

import copy
import json
import os
import stat
import uuid
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConfigError(ValueError):
    """All that is wrong with a configuration, one message a line."""


#: Bytes of a private file, and copies of a configuration that are kept.
PRIVATE_BYTES, BACKUPS = 256 << 10, 5


def load_private(path: str | Path) -> Any:
    """The JSON of a regular file that its owner alone can read, no link, of at most 256 KiB."""
    found = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0) | getattr(os, "O_NONBLOCK", 0))
    with os.fdopen(found, "rb") as f:
        info = os.fstat(found)
        if not stat.S_ISREG(info.st_mode):
            raise ConfigError(f"not a regular file: {path}")
        if os.name == "posix" and info.st_mode & 0o077:
            raise ConfigError(f"others can reach {path}")
        content = f.read(PRIVATE_BYTES + 1)
    if len(content) > PRIVATE_BYTES:
        raise ConfigError(f"larger than {PRIVATE_BYTES} bytes: {path}")
    try:
        return json.loads(content.decode("utf-8"))
    except ValueError as error:
        raise ConfigError(f"no JSON in UTF-8: {path}") from error


def json_safe(value: Any) -> Any:
    """The same value of JSON's kinds: paths as text, keys as text, tuples and sets as lists."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [json_safe(v) for v in value]
    return str(value) if isinstance(value, os.PathLike) else value


def _backups(path: Path) -> list[Path]:
    """The newest first."""
    return sorted(path.parent.glob(f"{path.stem}.*.bak{path.suffix}"), reverse=True)


def save(tree: dict, path: str | Path) -> None:
    """Replaces a configuration file at once, readable by its owner alone; the file before is kept, as are the four before that."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with os.fdopen(os.open(draft, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding="utf-8") as f:
        json.dump(json_safe(tree), f, indent=2)
        f.flush()
        os.fsync(f.fileno())
    if path.exists():
        os.replace(path, path.with_name(f"{path.stem}.{datetime.now():%Y%m%dT%H%M%S%f}.bak{path.suffix}"))
    os.replace(draft, path)
    for old in _backups(path)[BACKUPS:]:
        old.unlink()


def load(defaults: dict, path: str | Path) -> tuple[dict, str | None]:
    """(configuration, where it is from): the file's values over the defaults; where it can't be read, those of the newest copy that can;
    without any, the defaults, from None."""
    path = Path(path)
    for source in (path, *_backups(path)):
        try:
            found = json.loads(source.read_text(encoding="utf-8"))
            if isinstance(found, dict):
                return merge(defaults, found), str(source)
        except (OSError, ValueError):
            continue
    return copy.deepcopy(defaults), None


def _parts(path: str) -> list[str]:
    parts = path.split(".")
    if not all(parts):
        raise ConfigError(f"empty component in path: {path!r}")
    return parts


def get_path(tree: dict, path: str) -> Any:
    for p in _parts(path):
        if not isinstance(tree, dict) or p not in tree:
            raise ConfigError(f"no such setting: {path}")
        tree = tree[p]
    return tree


def set_path(tree: dict, path: str, value: Any) -> None:
    *up, last = _parts(path)
    for p in up:
        tree = tree.setdefault(p, {})
        if not isinstance(tree, dict):
            raise ConfigError(f"not a section: {p} in {path}")
    tree[last] = value


def delete_path(tree: dict, path: str) -> None:
    *up, last = _parts(path)
    holder = get_path(tree, ".".join(up)) if up else tree
    if not isinstance(holder, dict) or last not in holder:
        raise ConfigError(f"no such setting: {path}")
    del holder[last]


def _fits(value: Any, default: Any) -> bool:
    if default is None:
        return True
    if isinstance(default, bool) or isinstance(value, bool):
        return isinstance(default, bool) and isinstance(value, bool)
    return isinstance(value, (int, float)) if isinstance(default, float) else isinstance(value, type(default))


def merge(defaults: dict, user: dict, strict: bool = True) -> dict:
    """User values over defaults; unknown keys stay. A value of another kind is an error, or without strict gives way to the default."""
    wrong: list[str] = []

    def walk(d, u, at):
        out = copy.deepcopy(d)
        for k, v in u.items():
            path = f"{at}{k}"
            if k in d and isinstance(d[k], dict) and isinstance(v, dict):
                out[k] = walk(d[k], v, f"{path}.")
            elif k in d and (isinstance(d[k], dict) or not _fits(v, d[k])):
                wrong.append(f"{path}: expected {type(d[k]).__name__}, found {type(v).__name__}")
            else:
                out[k] = copy.deepcopy(v)
        return out

    merged = walk(defaults, user, "")
    if wrong and strict:
        raise ConfigError("\n".join(wrong))
    return merged


def parse_value(text: str, default: Any) -> Any:
    """A value from text, of its default's kind; where that is open, JSON or the text itself."""
    low = text.strip().lower()
    if isinstance(default, bool):
        if low in ("true", "yes", "on", "1"):
            return True
        if low in ("false", "no", "off", "0"):
            return False
        raise ConfigError(f"not a boolean: {text}")
    if default is not None and low in ("null", "none"):
        return None
    try:
        if isinstance(default, int):
            return int(text)
        if isinstance(default, float):
            return float(text)
    except ValueError as error:
        raise ConfigError(f"not a number: {text}") from error
    if isinstance(default, str):
        return text
    try:
        return json.loads(text)
    except ValueError:
        return text


def leaves(spark: SparkSession, tree: dict) -> DataFrame:
    """path, value (JSON) of every leaf."""
    rows: list[tuple[str, str]] = []

    def walk(node, at):
        for k, v in node.items():
            walk(v, f"{at}{k}.") if isinstance(v, dict) and v else rows.append((f"{at}{k}", json.dumps(json_safe(v))))

    walk(tree, "")
    return spark.createDataFrame(rows, "path string, value string")


def merged_leaves(defaults: DataFrame, user: DataFrame) -> DataFrame:
    """The same merge as a join of leaves."""
    d, u = defaults.withColumnRenamed("value", "d"), user.withColumnRenamed("value", "u")
    return d.join(u, "path", "full").select("path", F.coalesce("u", "d").alias("value"))
