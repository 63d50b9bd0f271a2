"""python -m tests.run_oracle [FOLDER] [NAME...]: queries against their SQL, with times."""

import sys
import time

import __spark_entry__ as entry
from framewright.session import local_session
from tests.compare import compare


def main() -> None:
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, sql = local_session(), entry.oracle_sql()
    for name, query in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            if name in sql:
                ok, what = compare(spark, query, sql[name], folder)
            else:
                ok, what = True, f"{query(spark, folder).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            ok, what = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(("ok   " if ok else "FAIL ") + f"{name} {time.time() - t:.1f}s {what}", flush=True)


if __name__ == "__main__":
    main()
