"""Time the headline queries and print one JSON line. Data: $BENCH_SF_DIR; cores: $BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cuemill.catalog import load  # noqa: E402
from cuemill.session import local_session  # noqa: E402

HEADLINE = [
    "rhythm", "pauses", "retained_segments", "remap_words", "words_in_segments", "cuts_inside_words", "audit_cut_plan", "speech_regions", "smooth_activity",
    "structure_timeline", "nearest_frame", "html_gate", "extract_images", "extract_links", "keep_first", "top_comments", "qa_cards", "unanswered", "rhythm_pieces",
    "verify_quotes", "refine_boundaries", "map_time", "audit_reveals", "review_text",
]

#: Seconds after which no further query is begun, so that the line of figures is printed in any case.
LIMIT_S = int(os.environ.get("BENCH_LIMIT_S", "1200"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench", shuffle=int(cpus) if cpus.isdigit() else 8)
    catalog = load()
    spark.range(1000).selectExpr("sum(id)").collect()
    took, begun = {}, time.time()
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            t = time.time()
            catalog[name].run(spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
            if time.time() - begun > LIMIT_S:
                break
        took[name] = round(min(runs), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
        if time.time() - begun > LIMIT_S:
            print(f"stopped after {LIMIT_S} s, not timed: {names[len(took):]}", file=sys.stderr, flush=True)
            break
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
