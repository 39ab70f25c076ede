"""Node kinds by name, JSON specs and their repair, and the engine that joins them to a graph."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .dag import Dag, Node, RunReport
from .errors import SpecError, UnknownNode


def normalise(value: Any, schema: dict, root: dict | None = None) -> Any:
    """Repair common slips of a spec against a small JSON schema.

    {"item": x} and numeric-keyed objects become arrays, numeric strings numbers,
    "true" and "false" booleans; null passes where anyOf allows it."""
    root = schema if root is None else root
    if "$ref" in schema:
        at: Any = root
        for step in schema["$ref"].removeprefix("#/").split("/"):
            at = at[step]
        schema = at
    if "anyOf" in schema:
        if value is None:
            return None
        schema = next((s for s in schema["anyOf"] if s.get("type") != "null"), {})
    kind = schema.get("type")
    if kind == "array":
        if isinstance(value, dict) and set(value) == {"item"}:
            value = value["item"] if isinstance(value["item"], list) else [value["item"]]
        elif isinstance(value, dict) and value and all(re.fullmatch(r"\d+", k) for k in value):
            value = [value[k] for k in sorted(value, key=int)]
        return [normalise(v, schema.get("items", {}), root) for v in value] if isinstance(value, list) else value
    if kind == "object" and isinstance(value, dict):
        props = schema.get("properties", {})
        return {k: normalise(v, props.get(k, {}), root) for k, v in value.items()}
    if isinstance(value, str):
        if kind == "integer" and re.fullmatch(r"[+-]?\d+", value):
            return int(value)
        if kind == "number":
            try:
                return float(value)
            except ValueError:
                return value
        if kind == "boolean" and value.lower() in ("true", "false"):
            return value.lower() == "true"
    return value


class Registry:
    def __init__(self):
        self.kinds: dict[str, tuple[Callable[..., Node], dict]] = {}

    def register(self, kind: str, build: Callable[..., Node], schema: dict) -> None:
        self.kinds[kind] = (build, {"type": "object", **schema})

    def info(self, kind: str) -> dict[str, Any]:
        """A kind's documentation and spec schema, as JSON values."""
        if kind not in self.kinds:
            raise UnknownNode(f"no node kind {kind!r}")
        build, schema = self.kinds[kind]
        return {"kind": kind, "doc": (build.__doc__ or "").strip(), "spec": schema}

    def catalogue(self) -> list[dict[str, Any]]:
        return [self.info(k) for k in sorted(self.kinds)]

    def build(self, spark: SparkSession, kind: str, spec: dict) -> Node:
        if kind not in self.kinds:
            raise UnknownNode(f"no node kind {kind!r}")
        build, schema = self.kinds[kind]
        spec = normalise(spec, schema)
        if missing := [k for k in schema.get("required", []) if k not in spec]:
            raise SpecError(f"{kind}: {', '.join(missing)} is missing")
        if unknown := [k for k in spec if k not in schema.get("properties", {})]:
            raise SpecError(f"{kind}: {', '.join(unknown)} is unknown")
        return build(spark, **spec)


class Engine:
    """A graph with nodes built from JSON specs, and paged views of their outputs."""

    def __init__(self, spark: SparkSession, registry: Registry | None = None):
        from .nodes import default_registry

        self.spark, self.registry, self.dag = spark, registry or default_registry(), Dag()

    def add(self, node_id: str, kind: str, spec: dict | str | None = None) -> None:
        self.dag.add_node(node_id, self.registry.build(self.spark, kind, json.loads(spec) if isinstance(spec, str) else spec or {}))

    def update(self, node_id: str, kind: str, spec: dict) -> None:
        self.dag.replace_node(node_id, self.registry.build(self.spark, kind, spec))

    def ports(self, node_id: str) -> dict[str, Any]:
        """A node's input and output ports with their schemas; inputs are null where any number may be connected."""
        p = self.dag.nodes[node_id].ports()
        show = lambda ports: None if ports is None else {k: v.simpleString() if v is not None else None for k, v in ports.items()}
        return {"inputs": show(p.inputs), "outputs": show(p.outputs)}

    def connect(self, src: str, dst: str, from_port: int = 0, to_port: int = 0) -> None:
        self.dag.add_edge(src, dst, from_port, to_port)

    def run(self, **options) -> RunReport:
        return self.dag.run(**options)

    def output(self, node_id: str, port: int = 0) -> DataFrame:
        return self.dag.outputs[node_id][port]

    def page(self, node_id: str, offset: int = 0, limit: int = 100) -> dict:
        """A page of a node's output as JSON values; limit 0 for all rows."""
        df = self.output(node_id)
        out: dict[str, Any] = {"columns": df.columns, "total_rows": None, "count_error": None, "data": [], "collect_error": None}
        try:
            out["total_rows"] = df.count()
        except Exception as e:  # noqa: BLE001
            out["count_error"] = str(e)
        try:
            rows = df.offset(offset)
            out["data"] = [json.loads(x) for x in (rows.limit(limit) if limit else rows).toJSON().collect()]
        except Exception as e:  # noqa: BLE001
            out["collect_error"] = str(e)
        return out | {"returned_rows": len(out["data"])}
