"""Operators for building training corpora: filters, scans, fingerprints, joins, shards and tokens.

Each module holds one operator with its own interface; ``queries`` registers a thin query for each.
Nothing outside this subpackage (but ``__spark_entry__`` and ``corpus_pipeline``) imports it.

Rules that hold for every operator here:

* it reads only the columns it names, so further input columns (whatever their names) play no part;
* a null text counts as an empty text, a null id is carried through and never dropped;
* repeated rows are rows of their own and come out as often as they went in;
* an empty table gives an empty result with the same columns;
* texts are always processed whole.
"""

import sys

from pyspark import cloudpickle

#: Functions that run in executors travel with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
