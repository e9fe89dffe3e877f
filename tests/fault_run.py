"""A solve on a small cluster of executors, one of which is killed in its midst; prints the distances. Run by test_faults.py."""

import json
import os
import sys
import tempfile
import threading
import time
from pathlib import Path

import pyspark

ROOT = str(Path(__file__).resolve().parent.parent)
#: Executors of a local cluster write below Spark's home, so it is a folder of ours that links to the parts of the real one, which may be read-only.
FOLDER = tempfile.mkdtemp(prefix="fault-run-")
for part in Path(pyspark.__file__).parent.iterdir():
    if part.name != "work":
        Path(FOLDER, "home").mkdir(exist_ok=True)
        Path(FOLDER, "home", part.name).symlink_to(part)
os.environ |= {"PYTHONPATH": os.pathsep.join([ROOT, str(Path(__file__).parent)]), "SPARK_SCALA_VERSION": "2.13", "SPARK_HOME": f"{FOLDER}/home", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
sys.path[:0] = [ROOT, str(Path(__file__).parent)]


def executors() -> list[int]:
    """Processes below this one that are executors."""
    parent, found = {}, []
    for p in Path("/proc").iterdir():
        if p.name.isdigit():
            try:
                parent[int(p.name)] = int((p / "stat").read_text().rpartition(")")[2].split()[1])
                if b"CoarseGrainedExecutorBackend" in (p / "cmdline").read_bytes():
                    found.append(int(p.name))
            except (OSError, IndexError):
                continue

    def below(pid: int) -> bool:
        while pid in parent and pid != os.getpid():
            pid = parent[pid]
        return pid == os.getpid()

    return [p for p in found if below(p)]


def main() -> None:
    from graphs import frame, random_graph
    from pyspark.sql import SparkSession

    from pathloom.operators import sssp

    os.chdir(FOLDER)
    spark = (
        SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", f"file://{FOLDER}/shared").config("spark.sql.warehouse.dir", f"file://{FOLDER}/warehouse").config("spark.driver.host", "127.0.0.1").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    killed = []

    def strike() -> None:
        # The first table of a round is there, so rounds are under way.
        while not any(Path(FOLDER).glob("shared/*/level-*/_SUCCESS")) and not any(Path(FOLDER).glob("shared/*/owned-*/_SUCCESS")):
            time.sleep(0.05)
        killed.extend(executors()[:1])
        if killed:
            os.kill(killed[0], 9)

    df = frame(spark, random_graph(1))
    hit = threading.Thread(target=strike)
    hit.start()
    found = sssp.solve(df, sssp.sources_frame(df, [0]), sys.argv[1], **json.loads(sys.argv[2])).collect()
    hit.join()
    print("\nRESULT", json.dumps({"killed": len(killed), "rows": [[r["v"], r["dist"], r["hops"]] for r in found]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
