"""Options of a run, from a properties file or as keywords."""

from __future__ import annotations

from dataclasses import dataclass

METHODS = ("mapreduce", "delta", "dfs", "matrix", "pagerank")
# The option names, without the application's prefix.
REQUIRED = {
    "graph.data": ("graph_data", str),
    "graph.size": ("graph_size", int),
    "graphA.size": ("n_a", int),
    "graphB.size": ("n_b", int),
    "iterations": ("iterations", int),
    "partitions": ("partitions", int),
}
EXTRA = {
    "impl.type": ("method", str),
    "initSimMatPath": ("similarity_path", str),
    "diagSimMatPath": ("identity_path", str),
    "delta.epsilon": ("epsilon", float),
    "matrix.graphPartitions": ("slices", int),
    "matrix.useExternalCombine": ("external", lambda x: x.strip().lower() == "true"),
}
#: Options that a method can't do without.
OF_METHOD = {
    "mapreduce": ("initSimMatPath", "diagSimMatPath"),
    "delta": ("initSimMatPath", "delta.epsilon"),
    "dfs": ("initSimMatPath",),
    "matrix": ("initSimMatPath", "matrix.graphPartitions"),
    "pagerank": ("initSimMatPath",),
}


@dataclass
class Options:
    graph_data: str
    graph_size: int
    n_a: int
    n_b: int
    iterations: int
    partitions: int
    method: str | None = None
    similarity_path: str | None = None
    identity_path: str | None = None
    epsilon: float = 1e-4
    slices: int = 2
    external: bool = False
    c: float = 0.8

    def __post_init__(self):
        if self.method is not None and self.method not in METHODS:
            raise ValueError(f"no such method: {self.method}")
        if self.slices < 2:
            raise ValueError("matrix.graphPartitions must be over 1")


def read_properties(text: str) -> dict[str, str]:
    """Keys and values of a properties file; lines that begin with # or ! are comments."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        if line and line[0] not in "#!":
            cut = min((k for k in map(line.find, "=: \t") if k >= 0), default=len(line))
            out[line[:cut]] = line[cut:].strip(" \t=:")
    return out


def options(properties: dict[str, str]) -> Options:
    """Keys may carry any prefix of one word (``x.graph.data``); unknown ones are passed over. A missing required key raises OSError."""
    known = REQUIRED | EXTRA
    properties = {name: v for k, v in properties.items() for name in (k, k.partition(".")[2]) if name in known}
    method = properties.get("impl.type")
    for key in (*REQUIRED, *OF_METHOD.get(method, ())):
        if key not in properties:
            raise OSError(f"{key} should be set")
    return Options(**{known[k][0]: known[k][1](v) for k, v in properties.items()})
