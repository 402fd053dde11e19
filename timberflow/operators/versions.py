"""Versions of a store: immutable folders, and a pointer that names those that are live.

A change writes new folders below ``data/generation=<n>`` and then one row of the pointer table, which is what makes them live.
Until that row is there, readers see the version before, whole; a run that fails leaves folders no pointer names, which the
next run overwrites.  Snapshots name folders too.  :meth:`Versions.cleanup` removes what neither the newest pointer nor a
snapshot names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberflow import schemas
from timberflow.operators import quality, sinks
from timberflow.operators.dedup import event_index
from timberflow.operators.folders import folders, remove
from timberflow.operators.keys import KeyTable

_POINTER = "generation bigint, segments array<string>, incidents string, index string, manifest string, root_digest string"
_NONE = {"generation": 0, "segments": [], "incidents": None, "index": None, "manifest": None, "root_digest": ""}


def generation_of(path: str) -> int:
    return int(path.split("generation=")[1].split("/")[0])


@dataclass
class Versions:
    spark: SparkSession
    root: str

    def _pointers(self) -> DataFrame:
        if not folders(self.spark, self.root).count("generations"):
            return self.spark.createDataFrame([], _POINTER)
        return self.spark.read.schema(_POINTER).parquet(f"{self.root}/generations")

    def current(self) -> dict:
        newest = self._pointers().orderBy(F.desc("generation")).first()
        return dict(_NONE) if newest is None else newest.asDict()

    def read_events(self, state: dict) -> DataFrame:
        schema = schemas.ddl(schemas.EVENTS)
        if not state["segments"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{segment}" for segment in state["segments"]])
        return quality.checked(rows, quality.event_violation())

    def read_incidents(self, state: dict) -> DataFrame:
        schema = schemas.ddl(schemas.INCIDENTS)
        if state["incidents"] is None:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{state['incidents']}")
        return quality.checked(rows, quality.incident_violation())

    def events(self) -> DataFrame:
        return self.read_events(self.current())

    def incidents(self) -> DataFrame:
        return self.read_incidents(self.current())

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.current()['index']}")

    def keys(self, state: dict) -> KeyTable:
        return KeyTable(self.spark, self.root, [generation_of(segment) for segment in state["segments"]])

    def write(self, events: DataFrame | None = None, replace: bool = False, incidents: DataFrame | None = None) -> dict:
        """Write the folders of the next version and return its pointer, which is not live yet.

        ``events`` become a further segment, or with ``replace`` the only one; their keys are written with them.
        """
        state = self.current()
        state["generation"] += 1
        folder = f"data/generation={state['generation']}"
        if events is not None:
            sinks.save_events(events, f"{self.root}/{folder}/events", mode="overwrite")
            written = self.spark.read.schema(schemas.ddl(schemas.EVENTS)).parquet(f"{self.root}/{folder}/events")
            KeyTable(self.spark, self.root, []).add(written, state["generation"])
            state["segments"] = ([] if replace else list(state["segments"])) + [f"{folder}/events"]
            state["index"] = None
        if incidents is not None:
            sinks.save_incidents(incidents, f"{self.root}/{folder}/incidents", mode="overwrite")
            state["incidents"] = f"{folder}/incidents"
        return state

    def write_index(self, state: dict) -> dict:
        """Add the index of the version's events, derived from them."""
        path = f"data/generation={state['generation']}/index"
        event_index(self.read_events(state)).write.mode("overwrite").parquet(f"{self.root}/{path}")
        return state | {"index": path}

    def switch(self, state: dict) -> None:
        """Make a written version live: one row in one small file."""
        row = [tuple(state[name] for name in _NONE)]
        self.spark.createDataFrame(row, _POINTER).coalesce(1).write.mode("append").parquet(f"{self.root}/generations")

    def _named(self, states: Iterable[dict]) -> set[str]:
        return {path for state in states for path in (*state["segments"], state["incidents"], state["index"]) if path}

    def cleanup(self, snapshots: Iterable[dict] = ()) -> list[str]:
        """Remove folders of tables, keys and manifests that neither the newest pointer nor a given snapshot names."""
        live = self.current()
        states = [live, *snapshots]
        named, gone = self._named(states), []
        segments = {generation_of(path) for state in states for path in state["segments"]}
        for name in folders(self.spark, f"{self.root}/data"):
            for table in folders(self.spark, f"{self.root}/data/{name}"):
                if f"data/{name}/{table}" not in named:
                    gone.append(f"data/{name}/{table}")
        places = ["keys", *[f"filters/{name}" for name in folders(self.spark, f"{self.root}/filters")]]
        for place in places:
            gone += [f"{place}/{name}" for name in folders(self.spark, f"{self.root}/{place}") if int(name.split("=")[1]) not in segments]
        manifests = {state.get("manifest") for state in states}
        gone += [f"manifests/{name}" for name in folders(self.spark, f"{self.root}/manifests") if f"manifests/{name}" not in manifests]
        for path in gone:
            remove(self.spark, f"{self.root}/{path}")
        return gone
