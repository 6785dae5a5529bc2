"""python tests/run_checks.py SF_DIR [name prefix ...]: every query against its SQL."""

import sys
import time
import traceback

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

import oracle  # noqa: E402

from quillframe.plans import catalog  # noqa: E402
from quillframe.session import local_session  # noqa: E402

spark = local_session(8)
spark.sparkContext.setLogLevel("ERROR")
sf = sys.argv[1]
bad = 0
for name, fn in catalog.QUERIES.items():
    if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
        continue
    start = time.time()
    try:
        if name in catalog.ORACLES:
            out = oracle.compare(spark, sf, fn, catalog.ORACLES[name])
        else:
            out = f"rows only: {fn(spark, sf).count()}"
    except Exception as e:  # report and go on
        out = "ERROR " + str(e)[:1500]
        if "-v" in sys.argv:
            traceback.print_exc()
    if out is not None and not out.startswith("rows only"):
        bad += 1
    print(f"{name:34s} {time.time() - start:6.1f}s spark {oracle.SPENT['spark']:5.1f}s {out or 'ok'}", flush=True)
print("bad:", bad)
