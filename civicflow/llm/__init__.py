"""Training-data operators: toxicity, decontamination, language id, quality, sharding, quotation
linking, sampled segmentations, near-duplicates, line dedup, exact top-k, mixing, whitening and
Merkle manifests.

Nothing else in the library imports this package. Its functions travel to the executors by value,
so a cluster needs only numpy, pandas and pyarrow there, not an installation of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
