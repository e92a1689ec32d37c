"""logweave: log templates, OCSF labelling and security events as Spark DataFrame jobs.

Every public operator takes DataFrames (plus small configuration) and returns a
DataFrame; nothing is collected to the driver in the core path.

Sub-packages
------------
sources    readers and writers: log lines, rule tables, decisions, snapshots
functions  column expressions: masks, tokens, labels, OCSF event structs, similarity
operators  DataFrame -> DataFrame operators: labelling, compiling, matching,
           mining, sampling, life cycle, reports, review requests
plans      end-to-end jobs composed from operators (ingest, approve, restart)
streaming  Structured Streaming versions of the ingest path and keyed state
"""

from logweave.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
