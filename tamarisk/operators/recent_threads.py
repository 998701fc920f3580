"""The most recent threads of a sender, folded over time-ordered mail.

This is the one piece of per-row Python: "the k latest distinct threads at
every moment" is no window function.  The batch scan and the streaming state
share it.
"""

from __future__ import annotations


class RecentThreads:
    """At most ``cap`` threads, the least recently used one leaves first."""

    def __init__(self, cap: int, entries=()):
        self.cap = cap
        self.threads: dict = dict(entries)

    def note(self, thread, at: int, mail) -> None:
        """Take in a mail; calls come in time order."""
        self.threads.pop(thread, None)
        self.threads[thread] = (at, mail)
        if len(self.threads) > self.cap:
            del self.threads[next(iter(self.threads))]

    def newest_first(self):
        return reversed(self.threads.items())

    def recent(self, limit: int) -> list:
        """Latest mail of each of the latest threads."""
        out = []
        for _thread, (_at, mail) in self.newest_first():
            if len(out) == limit:
                break
            out.append(mail)
        return out

    def oldest_of(self, limit: int, current):
        """Time of the last of the ``limit`` latest threads besides ``current``."""
        last, seen = None, 0
        for thread, (at, _mail) in self.newest_first():
            if seen == limit:
                break
            if thread != current:
                last, seen = at, seen + 1
        return last
