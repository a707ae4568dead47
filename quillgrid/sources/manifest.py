"""Run manifests, their comparability, providers of external answers, prompts and sessions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import cells

#: Keys that say in which order rows ran.
ORDER_KEYS = ("order_id", "order_seed", "input_order")


def comparable(manifest: Mapping, truth: str | None = None, keys: Sequence[str] | None = None) -> dict:
    """What two runs must share to be compared: the manifest's settings, flat, and the truth file's name."""
    flat: dict[str, object] = {}

    def walk(prefix: str, value: object) -> None:
        if isinstance(value, Mapping):
            for k, v in value.items():
                walk(f"{prefix}.{k}" if prefix else str(k), v)
        else:
            flat[prefix] = value

    walk("", {k: v for k, v in manifest.items() if k not in ("prediction_file", "created_at")})
    out = {k: v for k, v in flat.items() if keys is None or k in keys}
    return out | ({"truth_file": truth} if truth is not None else {})


def signature(payload: Mapping) -> str:
    """SHA-256 of the payload as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def group_signature(payload: Mapping) -> str:
    """The signature without the keys of row order."""
    return signature({k: v for k, v in payload.items() if k.rsplit(".", 1)[-1] not in ORDER_KEYS})


def differing(a: Mapping, b: Mapping) -> list[str]:
    return sorted(k for k in {*a, *b} if a.get(k) != b.get(k))


def row_signature(*columns: str) -> Column:
    """SHA-256 of columns as JSON, in the given order."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def map_differences(a: Column | str, b: Column | str) -> Column:
    """The sorted keys at which two maps differ; a missing key differs from a value."""
    x, y = cells.col(a), cells.col(b)
    return F.array_sort(F.filter(F.array_union(F.map_keys(x), F.map_keys(y)), lambda k: ~F.try_element_at(x, k).eqNullSafe(F.try_element_at(y, k))))


# --- strategies ---

Strategy = Callable[[DataFrame], DataFrame]


class Registry:
    """Row strategies by theme and name: functions DataFrame -> DataFrame, with aliases and a lifecycle."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, str], tuple[Strategy, bool, str]] = {}
        self._alias: dict[tuple[str, str], str] = {}

    def register(self, name: str, strategy: Strategy, *, theme: str = "target", aliases: Sequence[str] = (), enabled: bool = True, lifecycle: str = "stable") -> None:
        for a in (name, *aliases):
            if self._alias.get((theme, a.lower()), name) != name:
                raise ValueError(f"{a} is taken")
            self._alias[theme, a.lower()] = name
        self._known[theme, name] = (strategy, enabled, lifecycle)

    def get(self, name: str, theme: str = "target") -> Strategy:
        real = self._alias.get((theme, name.lower()))
        if real is None:
            raise KeyError(f"no strategy {name} of {theme}")
        return self._known[theme, real][0]

    def enabled(self, theme: str, candidates: bool = False) -> list[str]:
        return sorted(n for (t, n), (_, on, life) in self._known.items() if t == theme and on and (life == "stable" or candidates and life == "candidate"))


def consistency(registered: DataFrame, templates: DataFrame, key: str = "name") -> DataFrame:
    """Registered without a template, and templates that nothing registers: kind, key."""
    missing = registered.join(templates, key, "left_anti").select(F.lit("missing").alias("kind"), key)
    return missing.unionByName(templates.join(registered, key, "left_anti").select(F.lit("orphan").alias("kind"), key))


def replay(df: DataFrame, answers: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """A provider that replays recorded answers: rows with their answer, null where there is none. The engine itself makes no calls."""
    return df.join(answers.select(key, answer), key, "left")


def provide(df: DataFrame, ask: Callable[[str], str], prompt: str, answer: str = "answer") -> DataFrame:
    """A provider that asks row by row, batch by batch, within tasks; an error leaves an empty answer."""

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf[prompt]:
                try:
                    out.append(ask(p))
                except Exception:  # a failed call is a row without an answer
                    out.append("")
            yield pdf.assign(**{answer: out})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{answer}` string"
    return df.mapInPandas(run, schema)


# --- prompts ---


def prompt(parts: Mapping[str, Column | str], intro: str = "") -> Column:
    """Lines ``Name: value`` of the parts that aren't blank."""
    lines = [F.when(cells.text_of(c) != "", F.concat(F.lit(f"{n}: "), cells.text_of(c))) for n, c in parts.items()]
    return F.concat_ws("\n", *([F.lit(intro)] if intro else []), *lines)


def hint_block(hints: Column | str) -> Column:
    """``k=v; ...`` of a map's values that aren't blank, by key."""
    m = cells.col(hints)
    keys = F.filter(F.array_sort(F.map_keys(m)), lambda k: F.coalesce(F.btrim(F.try_element_at(m, k)), F.lit("")) != "")
    return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.try_element_at(m, k))), "; ")


# --- sessions ---


class Limits(NamedTuple):
    """A session is full at so many characters, or after so many rows (fixed values)."""

    characters: int = int(0.9 * 128_000)
    rows: int = 50


def context_full(df: DataFrame, session: str, order: str, text: str, most: int = Limits().characters) -> DataFrame:
    """Adds ``characters`` so far in the session and ``is_full``."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("characters", F.sum(F.length(F.coalesce(text, F.lit("")))).over(w)).withColumn("is_full", F.col("characters") > most)


def context_windows(df: DataFrame, session: str, order: str, text: str, limits: Limits = Limits()) -> DataFrame:
    """``windows.context_windows`` under a session's limits."""
    from quillgrid.operators import windows

    return windows.context_windows(df, session, order, text, limits.rows, limits.characters)


def messages(df: DataFrame, text: str, keep: bool) -> DataFrame:
    """Message texts only where full records are wanted."""
    return df if keep else df.withColumn(text, F.lit(None).cast("string"))
