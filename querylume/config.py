"""Settings, with the defaults and ranges that deployments rely on.

Transport settings are kept so that a configuration can be carried over; two of them
(otel_log_queue_size and otel_metric_interval_ms) have no effect.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from querylume.sources.schema import ERROR_LEVELS

MIB = 1 << 20
#: Smallest and largest values, both allowed.
RANGES = {
    "store_port": (1, 65535),
    "queue_capacity": (1024, 4194304),
    "string_area_size": (8, 1024),
    "flush_interval_ms": (100, 60000),
    "batch_max": (1, 1000000),
    "otel_log_queue_size": (512, 1048576),
    "otel_log_batch_size": (1, 131072),
    "otel_log_max_bytes": (65536, 64 * MIB),
    "otel_log_delay_ms": (10, 60000),
    "otel_metric_interval_ms": (100, 300000),
    "min_duration_us": (0, 2**31 - 1),
    "normalize_cache_max": (64, 65536),
    "sample_rate": (0.0, 1.0),
    "otel_max_block_bytes": (65536, 16 * MIB),
}


@dataclass(frozen=True)
class Config:
    """Thirty settings.  with_values() takes strings or values; what is invalid raises, and lenient() skips it."""

    enabled: bool = True
    use_otel: bool = False
    store_host: str = "localhost"
    store_port: int = 9000
    store_user: str = "default"
    store_password: str = ""
    store_database: str = "default"
    store_use_tls: bool = False
    store_skip_tls_verify: bool = False
    otel_endpoint: str = "localhost:4317"
    hostname: str = ""
    queue_capacity: int = 131072
    string_area_size: int = 64
    flush_interval_ms: int = 500
    batch_max: int = 200000
    otel_log_queue_size: int = 65536
    otel_log_batch_size: int = 8192
    otel_log_max_bytes: int = 3 * MIB
    otel_log_delay_ms: int = 100
    otel_metric_interval_ms: int = 5000
    log_min_elevel: str = "warning"
    min_duration_us: int = 0
    normalize_cache_max: int = 32768
    sample_rate: float = 1.0
    otel_arrow_passthrough: bool = False
    use_unified_arrow_exporter: bool = False
    otel_max_block_bytes: int = 3 * MIB
    extra_attributes: str = ""
    debug_arrow_dump_dir: str = ""
    debug_force_locked_overflow: bool = False

    def __post_init__(self) -> None:
        for name, (least, most) in RANGES.items():
            if not least <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be from {least} to {most}")
        if self.queue_capacity & (self.queue_capacity - 1):
            raise ValueError("queue_capacity must be a power of two")
        if self.log_min_elevel not in ERROR_LEVELS:
            raise ValueError(f"log_min_elevel must be one of {', '.join(ERROR_LEVELS)}")

    def with_values(self, **values: object) -> Config:
        return replace(self, **{k: parsed(type(getattr(self, k)), v) for k, v in values.items()})

    def lenient(self, **values: object) -> tuple[Config, dict[str, str]]:
        """Settings that are valid are taken one by one; the others keep their defaults and are reported."""
        out, refused = self, {}
        for name, value in values.items():
            try:
                out = out.with_values(**{name: value})
            except (ValueError, AttributeError) as error:
                refused[name] = str(error)
        return out, refused

    @property
    def sink(self) -> str:
        """Which sink the flags choose."""
        if not self.use_otel:
            return "table"
        if self.otel_arrow_passthrough:
            return "unified_arrow" if self.use_unified_arrow_exporter else "arrow"
        return "otlp"


def parsed(kind: type, value: object) -> object:
    if kind is bool and isinstance(value, str):
        words = {"on": True, "true": True, "yes": True, "1": True, "off": False, "false": False, "no": False, "0": False}
        if value.lower() not in words:
            raise ValueError(f"not a switch: {value}")
        return words[value.lower()]
    return value if isinstance(value, kind) else kind(value)  # type: ignore[call-arg]


NAMES = tuple(f.name for f in fields(Config))
