"""Named queries over the driver tables; importing registers them all."""

from . import (chat_plans, dataset_plans, document_plans, packing_plans, report_plans,  # noqa: F401
               sft_plans, shard_plans, source_plans, stream_plans)
