"""Index options, settings and the choice of an index for a search."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from nearfield.functions import metric_name
from nearfield.kernels import quantizers

#: Session settings; a call's argument goes before them, the index's own option after.
SETTINGS = {"ef_search": "nearfield.ef_search", "nprobe": "nearfield.nprobe", "l_search": "nearfield.l_search", "rerank": "nearfield.rerank"}


def setting(spark: SparkSession, name: str) -> int | None:
    """A session setting, if it is set to a positive number."""
    value = spark.conf.get(SETTINGS[name], None)
    return int(value) if value is not None and int(value) > 0 else None


_LIMITS = {
    "graph_m": (2, None), "graph_m0": (2, None), "ef_construction": (1, None), "ef_search": (1, None), "max_level": (0, None), "nlist": (2, None), "nprobe": (1, None),
    "replica_count": (1, None), "closure_factor": (1.0, None), "degree": (4, 256), "l_build": (4, 1024), "alpha": (1.0, 2.0), "rerank": (1, None), "shard_rows": (1, None),
}
DEFAULTS = {
    "hnsw": {"graph_m": 16, "graph_m0": None, "ef_construction": 100, "ef_search": 64, "max_level": 8},
    "ivf": {"nlist": 1024, "nprobe": 16, "normalize_cells": False},
    "spann": {"nlist": 1024, "nprobe": 16, "replica_count": 8, "closure_factor": 1.1, "normalize_cells": False},
    "diskann": {"degree": 64, "l_build": 100, "alpha": 1.2},
}
COMMON = {"rerank": 1, "shard_rows": 20_000}
_QUANTIZER_OPTIONS = {"bits": "bits", "pq_m": "m", "eta": "eta", "seed": "seed"}


@dataclass
class Options:
    """What an index is built with; raises ValueError on anything it can't take."""

    algorithm: str
    metric: str
    quantizer: str
    values: dict = field(default_factory=dict)
    quantizer_values: dict = field(default_factory=dict)

    @classmethod
    def of(cls, algorithm: str, metric: str = "l2sq", quantizer: str = "flat", **given: object) -> Options:
        algorithm, metric, quantizer = algorithm.lower(), metric_name(metric), quantizer.lower()
        if algorithm not in DEFAULTS:
            raise ValueError(f"unknown index type {algorithm!r}; expected one of {sorted(DEFAULTS)}")
        if quantizer not in quantizers.KINDS:
            raise ValueError(f"unknown quantizer {quantizer!r}; expected one of {sorted(quantizers.KINDS)}")
        if algorithm == "diskann" and quantizer == "flat":
            raise ValueError("DiskANN requires a compressing quantizer")
        if metric not in quantizers.KINDS[quantizer].metrics:
            raise ValueError(f"{quantizer} quantizer does not support {metric}")
        values = COMMON | DEFAULTS[algorithm]
        own = {}
        for name, value in given.items():
            if name in _QUANTIZER_OPTIONS:
                own[_QUANTIZER_OPTIONS[name]] = value
            elif name not in values:
                raise ValueError(f"{algorithm} index has no option {name!r}")
            else:
                low, high = _LIMITS.get(name, (None, None))
                if (low is not None and value < low) or (high is not None and value > high):
                    raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high else "") + f", not {value}")
                values[name] = value
        if algorithm == "hnsw":
            values["graph_m0"] = values["graph_m0"] or 2 * values["graph_m"]
            values["ef_construction"] = max(values["ef_construction"], values["graph_m"])
        if algorithm == "diskann":
            values["l_build"] = max(values["l_build"], values["degree"])
        if "nlist" in values:
            values["nprobe"] = min(values["nprobe"], values["nlist"])
        if "replica_count" in values and values["replica_count"] > values["nlist"]:
            raise ValueError("replica_count must not exceed nlist")
        return cls(algorithm, metric, quantizer, values, own)
