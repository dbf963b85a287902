"""cardinal: column-adding analytics cards on Spark DataFrames.

A user loads files into a DataFrame, filters rows, then applies declarative
*cards* (splits, ranking windows, rescaling, encodings, models, ...) that each
add columns.  Every data-sized step is a Spark job; only small fitted
parameters reach the driver.
"""

from cardinal.session import get_session, checkpoint_dir, reliable_checkpoint

__all__ = ["get_session", "checkpoint_dir", "reliable_checkpoint"]
