"""Training-data operators for very large corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, reads its input through Spark only, and keeps intermediate tables in
the folder that ``spark.checkpoint.dir`` names.
"""

import ctypes as _ctypes

import pyarrow as _pa

# Python workers live on between tasks: arrays and Arrow buffers that a task frees go back
# to the system, in place of pools that keep them beside the JVM of an executor.
_pa.set_memory_pool(_pa.system_memory_pool())
try:
    _ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, where the C library has it
except (AttributeError, OSError):
    pass
