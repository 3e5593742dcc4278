"""The registered queries of this subpackage."""

import cohortflow.llm.decontam  # noqa: F401
import cohortflow.llm.exact_dedup  # noqa: F401
import cohortflow.llm.langid  # noqa: F401
import cohortflow.llm.near_dup  # noqa: F401
import cohortflow.llm.packing  # noqa: F401
import cohortflow.llm.pii  # noqa: F401
import cohortflow.llm.suffix_dedup  # noqa: F401
import cohortflow.llm.token_counts  # noqa: F401
import cohortflow.llm.url_rules  # noqa: F401
import cohortflow.llm.warc  # noqa: F401
import cohortflow.llm.hard_negatives  # noqa: F401
import cohortflow.llm.bitsliced  # noqa: F401
import cohortflow.llm.toxicity  # noqa: F401
from cohortflow.llm.common import ORACLES, QUERIES  # noqa: F401
