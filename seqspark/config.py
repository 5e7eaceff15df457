"""Settings of an allocator and its node, checked before a job starts."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

from seqspark.functions.keys import MAX_KEY, SLOT_COUNT

SECOND = timedelta(seconds=1)


class ConfigError(ValueError):
    """A setting that no job may start with."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass(frozen=True)
class AllocatorConfig:
    default_step: int = 100
    max_step: int = 10_000
    prefetch_ratio: float = 0.5
    step_increase_threshold: timedelta = timedelta(minutes=15)
    step_decrease_threshold: timedelta = timedelta(minutes=30)
    reserve_timeout: timedelta = SECOND
    idle_timeout: timedelta = timedelta(hours=24)
    cleanup_interval: timedelta = SECOND
    cleanup_slots_per_run: int = 64
    memory_high_watermark_ratio: float = 0.9

    def validate(self) -> AllocatorConfig:
        none = timedelta(0)
        _need(self.default_step >= 1, "default_step must be positive")
        _need(self.max_step >= self.default_step, "max_step must not be below default_step")
        _need(0 < self.prefetch_ratio < 1, "prefetch_ratio must be between 0 and 1")
        _need(self.step_increase_threshold > none, "step_increase_threshold must be positive")
        _need(self.step_decrease_threshold > self.step_increase_threshold, "step_decrease_threshold must exceed step_increase_threshold")
        _need(self.reserve_timeout > none, "reserve_timeout must be positive")
        _need(self.idle_timeout > none, "idle_timeout must be positive")
        _need(self.cleanup_interval > none, "cleanup_interval must be positive")
        _need(1 <= self.cleanup_slots_per_run <= SLOT_COUNT, f"cleanup_slots_per_run must be from 1 to {SLOT_COUNT}")
        _need(0 < self.memory_high_watermark_ratio < 1, "memory_high_watermark_ratio must be between 0 and 1")
        _need(self.idle_timeout >= self.cleanup_interval, "idle_timeout must not be below cleanup_interval")
        return self


@dataclass(frozen=True)
class NodeConfig:
    node_id: str = ""
    heartbeat_timeout_ticks: int = 3
    heartbeat_ticks: int = 1
    route_query_timeout: timedelta = SECOND
    base_tick_interval: timedelta = SECOND

    def validate(self) -> NodeConfig:
        name = self.node_id.strip()
        _need(1 <= len(name.encode()) <= MAX_KEY, f"node_id must have 1 to {MAX_KEY} bytes")
        _need(self.route_query_timeout > timedelta(0), "route_query_timeout must be positive")
        _need(self.base_tick_interval > timedelta(0) and self.heartbeat_ticks > 0, "tick interval and heartbeat ticks must be positive")
        _need(self.heartbeat_timeout_ticks > self.heartbeat_ticks, "heartbeat_timeout_ticks must exceed heartbeat_ticks")
        return self


@dataclass(frozen=True)
class Config:
    allocator: AllocatorConfig = field(default_factory=AllocatorConfig)
    node: NodeConfig = field(default_factory=NodeConfig)

    @classmethod
    def of(cls, settings: dict) -> Config:
        """From nested settings; a name that is not known is an error, an explicit zero is not a default."""
        parts = {}
        for name, kind in (("allocator", AllocatorConfig), ("node", NodeConfig)):
            given = dict(settings.get(name, {}))
            unknown = sorted(set(given) - set(kind.__dataclass_fields__))
            _need(not unknown, f"{name} has no settings {', '.join(unknown)}")
            parts[name] = kind(**given).validate()
        unknown = sorted(set(settings) - set(parts))
        _need(not unknown, f"there are no settings {', '.join(unknown)}")
        return cls(**parts)
