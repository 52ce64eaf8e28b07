"""Movement and mark-recapture analytics expressed as Spark DataFrame plans."""

import os

# Spark runs one task a core: linear algebra inside a task stays on one thread.
for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS"):
    os.environ.setdefault(_name, "1")

__version__ = "0.1.0"
