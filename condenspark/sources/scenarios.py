"""Small synthetic logs, a scenario each, with manifests of what must not be lost. All sentences are invented."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

STAMP = "2026-03-0{d} 0{h}:{m:02d}:{s:02d}"


def _stamp(i: int) -> str:
    return STAMP.format(d=1 + i // 32400, h=i // 3600 % 9, m=i // 60 % 60, s=i % 60)


def _usual(n: int, say: Callable[[int], str]) -> Iterator[str]:
    return (f"{_stamp(i)} {say(i)}" for i in range(n))


def _sign_in_burst() -> Iterator[str]:
    yield from _usual(50, lambda i: f"[INFO] session {i} opened")
    yield from (f"{_stamp(60)} [WARN] sign-in rejected for account {i} from 10.1.{i % 250}.{i % 199}" for i in range(500))
    yield f"{_stamp(61)} [CRITICAL] sign-in service locked"


def _build_failure() -> Iterator[str]:
    steps = ("fetch", "lint", "types", "unit", "docs", "pack", "scan", "sign", "push", "warm", "probe", "switch", "purge")
    for name in steps:
        yield from (f"{_stamp(i)} [{name}] passed after {i}ms" for i in range(7))
    yield from (f"{_stamp(k)} ##[group]stage number {k}" for k in range(12))
    yield f"{_stamp(99)} ##[error]image is not signed"
    yield f"{_stamp(99)} [ERROR] release was halted"


def _pool_exhausted() -> Iterator[str]:
    yield from _usual(120, lambda i: f"[INFO] query {i} served in {i}ms")
    yield from _usual(150, lambda i: f"[WARN] pool holds {i} of 150 links")
    yield from _usual(60, lambda i: f"[INFO] retry number {i}")
    yield f"{_stamp(1)} [ERROR] no link could be had"
    yield f"{_stamp(2)} [ERROR] Traceback (most recent call last):"
    yield f'{_stamp(2)} [ERROR]   File "/srv/pool.py", line 41, in take'
    yield f"{_stamp(2)} [ERROR]     return self.idle.pop()"
    yield f"{_stamp(2)} [ERROR] PoolError: nothing is idle"
    yield from _usual(2, lambda i: f"[FATAL] giving up after {i} tries")


def _go_panic() -> Iterator[str]:
    yield from _usual(130, lambda i: f"level=info msg=tick seq={i}")
    yield from ("panic: index out of range", "", "goroutine 7 [running]:", "main.pick(0x4)", "\t/srv/pick.go:12 +0x1d", "main.main()", "\t/srv/main.go:9 +0x25", "exit status 2")


def _java_trace() -> Iterator[str]:
    yield from _usual(230, lambda i: f"INFO  [worker] Shop - basket {i} priced")
    yield f"{_stamp(9)} ERROR [worker] Shop - java.lang.IllegalStateException: no price"
    yield from ("\tat shop.Till.cost(Till.java:44)", "\tat shop.Till.sum(Till.java:31)", "\tat shop.Till.pay(Till.java:18)", "Caused by: java.io.IOException: shelf is away", "\tat shop.Shelf.read(Shelf.java:77)", "\t... 2 more")


def _node_trace() -> Iterator[str]:
    yield from _usual(190, lambda i: f"info: route=/cart took {i}ms")
    yield f"{_stamp(9)} error: TypeError: cart is undefined"
    yield from (f"    at step{k} (/srv/cart.js:{k}:5)" for k in "abc")


def _python_trace() -> Iterator[str]:
    yield from _usual(190, lambda i: f"[INFO] parcel {i} weighed")
    yield "Traceback (most recent call last):"
    yield from ('  File "/srv/scale.py", line 5, in weigh', "    return load / parts", '  File "/srv/parts.py", line 8, in parts', "    raise ValueError(n)", "ValueError: parts must not be 0")


def _healthy_then_fatal() -> Iterator[str]:
    says = ("heartbeat {i} sent", "page {i} rendered", "cache hit for {i}", "mail {i} queued")
    yield from _usual(2000, lambda i: "[INFO] " + says[i % 4].format(i=i))
    yield f"{_stamp(0)} [FATAL] disk is gone"


def _http_failure() -> Iterator[str]:
    line = '10.0.0.{a} - - [01/Mar/2026:00:00:{s:02d} +0000] "GET /{what} HTTP/1.1" {code} {n}'
    for k, what in enumerate(("list", "item", "cart")):
        yield from (line.format(a=i % 200, s=i % 60, what=what, code=200, n=i) for i in range(100 + 20 * k))
    yield from (line.format(a=i % 200, s=i % 60, what="pay", code=503, n=i) + " upstream timed out" for i in range(160))
    yield f"{_stamp(3)} [CRITICAL] no upstream is left"


def _restart_loop() -> Iterator[str]:
    for i in range(40):
        for say in ("Normal Pulled image is there", "Normal Created box made", "Normal Started box runs", "[INFO] reading settings", "[INFO] joining the ring", "[INFO] ring says hello", "[WARN] probe is late", "[FATAL] settings lack a key"):
            yield f"{_stamp(i)} {say} {i}"
    yield f"{_stamp(50)} [ERROR] back-off, no more restarts"


#: Lines, and what must be retained.
SCENARIOS: dict[str, tuple[Callable[[], Iterator[str]], list[str]]] = {
    "build-failure": (_build_failure, ["image is not signed", "release was halted"]),
    "go-panic": (_go_panic, ["index out of range"]),
    "healthy-then-fatal": (_healthy_then_fatal, ["disk is gone"]),
    "http-failure": (_http_failure, ["no upstream is left"]),
    "java-trace": (_java_trace, ["no price", "shelf is away"]),
    "node-trace": (_node_trace, ["cart is undefined"]),
    "pool-exhausted": (_pool_exhausted, ["no link could be had", "nothing is idle"]),
    "python-trace": (_python_trace, ["parts must not be 0"]),
    "restart-loop": (_restart_loop, ["settings lack a key", "no more restarts"]),
    "sign-in-burst": (_sign_in_burst, ["sign-in service locked"]),
}


def lines(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """source (the scenario), line_no, raw."""
    rows = [(name, i, line) for name in names or SCENARIOS for i, line in enumerate(SCENARIOS[name][0]())]
    return spark.createDataFrame(rows, "source string, line_no long, raw string")


def manifests(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    rows = [(name, True, sum(1 for _ in SCENARIOS[name][0]()), SCENARIOS[name][1], "") for name in names or SCENARIOS]
    return spark.createDataFrame(rows, "scenario string, synthetic boolean, total_lines long, known_important_substrings array<string>, description string")
