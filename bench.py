"""Times the headline queries once each, after a warm-up, and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from loomline import catalogue
from loomline.session import local_session

HEADLINE = (
    "conversation_timeline_summary", "dialogue_script", "timeline", "speech_windows", "generation_blocks", "apportion_audio", "target_sweep", "html_to_text", "sentence_split", "sentence_windows", "text_spans",
    "reading_units", "marked_text", "stitch_offsets", "normalize_name", "alias_bridge", "resolve_names", "match_candidates", "coverage_check", "stale_rows", "registry_merge", "book_summary", "perf_rollup", "sweep_average", "pcm_encode",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
