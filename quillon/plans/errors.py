"""Errors of the workflow engine; ``kind`` is their stable name in reports."""


class EngineError(Exception):
    kind = "node_error"


def _kind(name: str, kind: str) -> type[EngineError]:
    return type(name, (EngineError,), {"kind": kind})


CycleError = _kind("CycleError", "cycle")
UnknownNode = _kind("UnknownNode", "unknown_node")
DuplicateNode = _kind("DuplicateNode", "duplicate_node")
PortNotFound = _kind("PortNotFound", "port_not_found")
PortDisconnected = _kind("PortDisconnected", "port_disconnected")
PortOverconnected = _kind("PortOverconnected", "port_overconnected")
SchemaMismatch = _kind("SchemaMismatch", "schema_mismatch")
EdgeNotFound = _kind("EdgeNotFound", "edge_not_found")
SpecError = _kind("SpecError", "spec")
