"""plansight: product-event governance as Spark DataFrame plans."""

import sys as _sys

# Python functions shipped to executors (pandas UDFs, mapInPandas and
# applyInPandasWithState bodies) are pickled by value, so executors need no
# installed copy of this package.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
