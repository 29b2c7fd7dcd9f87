"""Registration and walks of people with guards: one state machine a person, as a stream with timers or as a fold over a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailspan.functions.identity import normal_email, valid_email

OUT = "person string, at timestamp, seq long, kind string, walk string, outcome string, reason string"
#: Hours after which an open walk is given up.
IDLE_H = 12
_SPAN = pd.Timedelta(hours=IDLE_H)


class Person:
    """What is known of one person: the hash of the token in force, the open walk with its state and when it was last touched, and the
    time and number of the last command. Times are Timestamps, or whole microseconds with a ``span`` of such."""

    def __init__(self, token: str | None = None, walk: str | None = None, state: str | None = None, touched: pd.Timestamp | None = None, last: tuple[pd.Timestamp, int] | None = None, span: pd.Timedelta | int = _SPAN):
        self.token, self.walk, self.state, self.touched, self.last, self.span = token, walk, state, touched, last, span

    def given_up(self, now: pd.Timestamp) -> tuple | None:
        """The walk's end if it has been idle for too long by ``now``."""
        if self.walk is None or now < self.touched + self.span:
            return None
        row = (self.touched + self.span, None, "expire", self.walk, "EXPIRED", None)
        self.walk = self.state = None
        return row

    def apply(self, at: pd.Timestamp, seq: int, kind: str, walk: str | None, token: str | None, new_token: str | None) -> Iterator[tuple]:
        """Rows (at, seq, kind, walk, outcome, reason) of one command, after the row of a walk that was given up before it."""
        say = lambda outcome, reason=None: (at, seq, kind, walk, outcome, reason)
        if self.last is not None and (at, seq) <= self.last:
            yield say("REJECTED", "late or sent again")
            return
        self.last = (at, seq)
        over = self.given_up(at)
        if over:
            yield over
        if kind == "register":
            if not new_token:
                yield say("REJECTED", "no token")
                return
            known, self.token = self.token is not None, new_token
            yield say("RETURNING" if known else "CREATED")
        elif self.token is None:
            yield say("REJECTED", "not registered")
        elif token != self.token:
            yield say("REJECTED", "token is not in force")
        elif kind == "preview":
            if self.state == "ACTIVE":
                yield say("REJECTED", "a walk is active")
                return
            if self.walk is not None and self.walk != walk:
                yield (at, seq, "discard", self.walk, "DISCARDED", "another preview")
            self.walk, self.state, self.touched = walk, "PREVIEW", at
            yield say("PREVIEW")
        elif self.walk != walk or walk is None:
            yield say("REJECTED", "not the open walk")
        elif kind == "start" and self.state == "PREVIEW":
            self.state, self.touched = "ACTIVE", at
            yield say("ACTIVE")
        elif kind == "discard" or (kind == "complete" and self.state == "ACTIVE"):
            self.walk = self.state = None
            yield say("DISCARDED" if kind == "discard" else "COMPLETED")
        else:
            yield say("REJECTED", f"cannot {kind} a walk in {self.state}")


def commands(rows: DataFrame) -> DataFrame:
    """``rows`` (email, at, seq, kind, walk, token, new_token, tokens being hashes) keyed by the normalised address; those without a
    valid one, a time or a number are left out (see refused)."""
    fine = valid_email(F.col("email")) & F.col("at").isNotNull() & F.col("seq").isNotNull()
    return rows.where(fine).select(normal_email(F.col("email")).alias("person"), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "kind", "walk", "token", "new_token")


def refused(rows: DataFrame) -> DataFrame:
    """The rows that ``commands`` leaves out, with the reason."""
    why = F.when(F.coalesce(valid_email(F.col("email")), F.lit(False)), "no time or number").otherwise("not an address")
    fine = F.coalesce(valid_email(F.col("email")), F.lit(False)) & F.col("at").isNotNull() & F.col("seq").isNotNull()
    return rows.where(~fine).withColumn("reason", why)


def _naive(at: pd.Timestamp) -> pd.Timestamp:
    at = pd.Timestamp(at)
    return at.tz_convert("UTC").tz_localize(None) if at.tzinfo else at


def _rows(person: Person, frame: pd.DataFrame) -> list[tuple]:
    out: list[tuple] = []
    for r in frame.sort_values(["at", "seq"], kind="stable").itertuples():
        none = lambda x: None if x is None or x != x else x
        out += person.apply(_naive(r.at), int(r.seq), r.kind, none(r.walk), none(r.token), none(r.new_token))
    return out


def _frame(name: str, rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame([(name, *r) for r in rows], columns=[c.split()[0] for c in OUT.split(", ")])
    return made.astype({"seq": "Int64", "at": "datetime64[us]"})


def folded(rows: DataFrame) -> DataFrame:
    """Outcomes (OUT) of all commands of a table, each person's in order of time and number; walks that are open at the end stay so.

    A task gets whole people, one after the other and in order, and keeps only
    what is known of the one at hand: neither a person with many commands nor
    many people with few cost more than their rows.
    """
    kind = OUT.replace("at timestamp", "at long")
    names = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, person = None, Person()
        for batch in batches:
            out: list[tuple] = []
            some = batch.astype({c: object for c in ("walk", "token", "new_token")})
            some = some.where(some.notna(), None)
            for who, at, seq, what, walk, token, new in zip(*(some[c].tolist() for c in ("person", "at", "seq", "kind", "walk", "token", "new_token"))):
                if who != name:
                    name, person = who, Person(span=IDLE_H * 3_600_000_000)
                out += [(who, *r) for r in person.apply(at, seq, what, walk, token, new)]
            made = pd.DataFrame(out, columns=names, dtype=object)
            yield made.assign(at=made["at"].astype("int64"), seq=pd.array(made["seq"].tolist(), "Int64"))  # a seq is never a double on its way

    given = commands(rows).withColumn("at", F.unix_micros("at")).repartition("person").sortWithinPartitions("person", "at", "seq")
    return given.mapInPandas(run, kind).withColumn("at", F.timestamp_micros("at"))


class People(StatefulProcessor):
    """The same as a stream: three state variables a person, and a timer that gives up an idle walk once the watermark has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.token = handle.getValueState("token", "hash string")
        self.walk = handle.getValueState("walk", "walk string, state string, touched_us long")
        self.last = handle.getValueState("last", "at_us long, seq long")

    def _person(self) -> Person:
        person = Person()
        if self.token.exists():
            person.token = self.token.get()[0]
        if self.walk.exists():
            person.walk, person.state, touched = self.walk.get()
            person.touched = pd.Timestamp(touched, unit="us")
        if self.last.exists():
            at, seq = self.last.get()
            person.last = (pd.Timestamp(at, unit="us"), seq)
        return person

    def _keep(self, person: Person) -> None:
        if person.token is not None:
            self.token.update((person.token,))
        if person.last is not None:
            self.last.update((person.last[0].value // 1000, person.last[1]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if person.walk is None:
            self.walk.clear()
        else:
            self.walk.update((person.walk, person.state, person.touched.value // 1000))
            self.handle.registerTimer((person.touched + _SPAN).value // 1_000_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        person = self._person()
        out = _rows(person, pd.concat(list(rows)))
        self._keep(person)
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        person = self._person()
        over = person.given_up(pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))
        self._keep(person)
        yield _frame(key[0], [over] if over else [])

    def close(self) -> None:
        pass


def walked(stream: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Outcomes (OUT) of a stream of commands. Guard violations are rows of outcome REJECTED with their reason, so a reject table is
    a filter of the result. Commands later than the watermark are dropped by Spark; those older than a person's last one are
    rejected. Needs the RocksDB state store."""
    keyed = commands(stream).withWatermark("at", lateness)
    return keyed.groupBy("person").transformWithStateInPandas(statefulProcessor=People(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
