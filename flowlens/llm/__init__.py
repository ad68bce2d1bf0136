"""Training-data operators (deduplication, packing, encoding, scoring, privacy).

Nothing else in the library imports this subpackage.  ``LLM_QUERIES`` holds
the ``opN_*`` queries, ``LLM_ORACLES`` the DuckDB texts of those SQL can
express; ``__spark_entry__`` adds both when the subpackage is present.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy

from .queries import LLM_ORACLES, LLM_QUERIES  # noqa: E402, F401
