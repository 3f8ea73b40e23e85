"""Detectors by name, and the chain of those that a run is to use."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.operators.entities import floor_entities, keep_entity, merged_types, scope_entities, without_wrappers

log = logging.getLogger(__name__)
#: A detector: texts and their keys to (keys, value, entity_type).
Detector = Callable[..., DataFrame]
FLOOR, SCOPE = "regex", "scope"
_DETECTORS: dict[str, Detector] = {}
#: Those whose findings always count, whatever their context.
_FIXED = {FLOOR, SCOPE}
#: Whether a contextual detector can be used, by name; one without an entry always can.
_READY: dict[str, Callable[[], bool]] = {}


def register(name: str, detector: Detector, ready: Callable[[], bool] | None = None) -> None:
    """Makes a contextual detector known; other names of one are registered like it. ``ready`` tells whether it can be used now."""
    _DETECTORS[name.lower()] = detector
    _READY.pop(name.lower(), None)
    if ready:
        _READY[name.lower()] = ready


def contextual_ready(names: list[str], scoped: bool = False) -> bool:
    """Whether any detector of a chain but the rules is there to find what rules can't; one whose check fails isn't. Only then do values that rules can't find count
    as leaks."""

    def ready(name: str) -> bool:
        try:
            return _READY.get(name, lambda: True)()
        except Exception as error:
            log.warning("detector %r can't be used: %s", name, error)
            return False

    return any(ready(name) for name in chain(names, scoped) if name != FLOOR)


def register_udtf(spark: SparkSession, name: str, find: Callable[[str], list[tuple[str, str]]]) -> None:
    """A function of a text that gives (value, entity_type) pairs as a table function for SQL: ``SELECT ... FROM t, LATERAL name(t.text)``. Texts and
    findings go as Arrow batches; many rows may come of a text; null texts, and texts at which the function fails, give none."""

    @F.udtf(returnType="value string, entity_type string", useArrow=True)
    class Find:
        def eval(self, text: str) -> Iterator[tuple[str, str]]:
            try:
                found = list(find(text)) if text is not None else []
            except Exception:  # a text that breaks a detector must not stop the others
                return
            yield from found

    spark.udtf.register(name, Find)


def from_function(find: Callable[[str], list[tuple[str, str]]], failures: object = None) -> Detector:
    """A detector from a function of a text that gives (value, entity_type) pairs. A text at which it fails has no findings;
    ``failures``, an accumulator, counts those."""

    def detect(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
        source = texts.select(*keys, F.col(text).alias("_text")).where("_text IS NOT NULL")
        kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name in keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = [], []
                for i, value in enumerate(batch.column("_text").to_pylist()):
                    try:
                        pairs = list(find(value))
                    except Exception:  # a text that breaks a detector must not stop the others
                        if failures is not None:
                            failures.add(1)
                        continue
                    rows += [i] * len(pairs)
                    found += pairs
                kept = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(kept) for k in keys), pa.array([v for v, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], names=[*keys, "value", "entity_type"])

        return source.mapInArrow(run, f"{kinds}value string, entity_type string")

    return detect


def chain(names: list[str], scoped: bool = False, contextual: bool = True) -> list[str]:
    """The detectors of a run in order: the rules first, then scope terms where there are any, then the named ones, each once.
    Unknown names are left out with a warning; without ``contextual`` only rules and scope stay."""
    wanted = [FLOOR, *([SCOPE] if scoped and SCOPE not in map(str.lower, names) else []), *map(str.lower, names)]
    ordered = list(dict.fromkeys(wanted))
    unknown = [n for n in ordered if n not in _FIXED and n not in _DETECTORS]
    for name in unknown:
        log.warning("no detector is called %r; it is left out", name)
    return [n for n in ordered if n not in unknown and (contextual or n in _FIXED) and (n != SCOPE or scoped)]


def detected(texts: DataFrame, names: list[str], *keys: str, scope: DataFrame | None = None, contextual: bool = True, text: str = "text") -> DataFrame:
    """(keys, value, entity_type, is_floor) of what a chain of detectors finds: types merged in the order of the chain,
    wrappers of precise values and contextual noise left out. A detector that can't be set up is left out with a warning."""
    parts = []
    for place, name in enumerate(chain(names, scope is not None, contextual)):
        try:
            if name == SCOPE:
                found = scope_entities(texts, scope, *keys, text=text)
            else:
                found = (floor_entities if name == FLOOR else _DETECTORS[name])(texts, *keys, text=text)
        except Exception as error:
            if name == FLOOR:
                raise
            log.warning("detector %r is left out: %s", name, error)
            continue
        parts.append(found.select(*keys, "value", "entity_type", F.lit(place).alias("chain"), F.lit(name in _FIXED).alias("is_floor")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    merged = merged_types(found, *keys)
    return without_wrappers(merged, *keys).where(keep_entity(F.col("value"), F.col("is_floor")))
