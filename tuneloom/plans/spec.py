"""Job specs: what to load, how to format or score it, how to lay it out.

The YAML keys are those of a fine-tuning run. Settings that concern the model or the
trainer only are carried along in ``passthrough`` and written back with the config echo.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from tuneloom.functions.formats import get_format

JOB_TYPES = ("sft", "grpo")


def _build(cls, values: Mapping[str, Any] | None, where: str):
    values = dict(values or {})
    known = {f.name: f for f in fields(cls) if f.name != "passthrough"}
    own = {k: v for k, v in values.items() if k in known}
    rest = {k: v for k, v in values.items() if k not in known}
    if rest and "passthrough" in {f.name for f in fields(cls)}:
        own["passthrough"] = rest
    elif rest:
        raise ValueError(f"Unknown settings in {where}: {sorted(rest)}")
    try:
        return cls(**own)
    except TypeError as error:
        raise ValueError(f"Bad settings in {where}: {error}") from error


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    config: str | None = None
    split: str = "train"
    format: str = "alpaca"
    column_map: dict[str, str] | None = None
    max_samples: int | None = None
    order_by: str | None = None
    key: str | None = None
    template: str | None = None

    def __post_init__(self):
        if not self.name:
            raise ValueError("The dataset needs a name")
        get_format(self.format)
        if self.max_samples is not None and self.max_samples < 0:
            raise ValueError("max_samples cannot be negative")


@dataclass(frozen=True)
class TrainSpec:
    epochs: float = 1.0
    per_device_train_batch_size: int = 2
    gradient_accumulation_steps: int = 4
    max_seq_length: int = 1024
    max_steps: int = -1
    logging_steps: int = 5
    save_steps: int = 200
    save_total_limit: int = 2
    passthrough: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class RewardSpec:
    name: str
    kwargs: dict[str, Any] = field(default_factory=dict)
    weight: float = 1.0
    scope: str = "row"
    columns: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class JobSpec:
    type: str
    dataset: DatasetSpec
    train: TrainSpec = field(default_factory=TrainSpec)
    seed: int = 42
    output_dir: str = "outputs/job"
    run_name: str | None = None
    rewards: list[RewardSpec] = field(default_factory=list)
    num_generations: int = 4
    max_prompt_length: int = 256
    max_completion_length: int = 256
    prompt_column: str = "prompt"
    passthrough: dict[str, Any] = field(default_factory=dict)

    def reward_dicts(self) -> list[dict[str, Any]]:
        if not self.rewards:
            raise ValueError("At least one reward is required")
        return [asdict(r) for r in self.rewards]

    def to_dict(self) -> dict[str, Any]:
        """The spec as it was given, with every default and the job type spelled out."""
        values = asdict(self)
        values.update(values.pop("passthrough"))
        values["train"].update(values["train"].pop("passthrough"))
        return values


def job_from_dict(values: Mapping[str, Any]) -> JobSpec:
    values = dict(values)
    kind = (values.pop("type", None) or "sft").lower()
    if kind not in JOB_TYPES:
        raise ValueError(f"Unknown job type {kind!r}. Choose from: {list(JOB_TYPES)}")
    if "dataset" not in values:
        raise ValueError("The job needs a dataset")
    rewards = [
        _build(RewardSpec, {"name": r} if isinstance(r, str) else r, "rewards")
        for r in values.pop("rewards", None) or []
    ]
    return _build(
        JobSpec,
        {
            **values,
            "type": kind,
            "dataset": _build(DatasetSpec, values["dataset"], "dataset"),
            "train": _build(TrainSpec, values.get("train"), "train"),
            "rewards": rewards,
        },
        "job",
    )


def job_from_yaml(text: str) -> JobSpec:
    try:
        import yaml
    except ImportError as error:  # pragma: no cover
        raise RuntimeError("Reading YAML specs needs PyYAML; use job_from_dict") from error
    return job_from_dict(yaml.safe_load(text))
