"""Fine-tuning data preparation as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

from tuneloom.functions.formats import FORMATS, TEMPLATES, ChatTemplate, get_format
from tuneloom.functions.group_rewards import GroupReward
from tuneloom.functions.resolve import (
    available_rewards,
    register_user_rewards,
    resolve_reward,
    resolve_rewards,
)
from tuneloom.functions.rewards import parse_keywords
from tuneloom.functions.text import first_field, parsed_shapes
from tuneloom.operators.capture import capture_rewards, capture_samples, recent_samples, sample_table
from tuneloom.operators.checkpoints import checkpoint_retention, latest_checkpoint
from tuneloom.operators.formatting import cap_tokens, format_rows
from tuneloom.operators.layout import batch_plan, permuted_schedule, step_schedule
from tuneloom.operators.prompts import (
    conversations,
    dialogue_pairs,
    generation_slots,
    join_completions,
    map_columns,
    prompt_column,
    zip_lists,
    zip_roles,
)
from tuneloom.operators.scoring import (
    group_advantage,
    long_rewards,
    mean_reward,
    score_group_reward,
    score_rewards,
    weighted_total,
)
from tuneloom.session import build_session, configure
from tuneloom.sources.datasets import (
    DatasetCatalog,
    first_rows,
    list_columns,
    load_dataset,
    preview_formatted,
    preview_json,
)
from tuneloom.sources.sinks import write_rows

# Reward functions travel with the helpers they use; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("sys", "cloudpickle")]
