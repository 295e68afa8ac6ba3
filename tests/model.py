"""The policy as a sequential model, event by event: what the relational form is held against."""

from __future__ import annotations


def starts(t: int, size: int, step: int) -> list[int]:
    return [s for s in range(t // step * step, t - size, -step) if s >= 0][::-1]


def policy(rows: list[tuple], size: int, step: int, lag: int, lateness: int = 0, ttl: int | None = None, domain: str = "event") -> dict:
    """rows: (event_time, key, event_id, ingest_time) in order of arrival. Counts."""
    seen: dict = {}
    state: dict = {}
    fired: set = set()
    wm, latest = -1, None
    out, side = [], []
    stats = dict.fromkeys(["processed", "duplicates_dropped", "dedup_expired", "late_but_accepted", "dropped_too_late", "windows_fired", "revisions", "aggregator_updates", "peak_state_entries"], 0)
    for seq, (t, key, ident, ingest) in enumerate(rows, 1):
        if ttl is not None and ident is not None:
            if ident in seen:
                stats["duplicates_dropped"] += 1
                continue
            seen[ident] = t
        stats["processed"] += 1
        latest = t if latest is None else max(latest, t)
        wm = max(wm, latest - lag)
        for s in starts(t if domain == "event" else ingest, size, step):
            end = s + size
            if end + lateness <= wm:
                stats["dropped_too_late"] += 1
                side.append((seq, key, s))
                continue
            state[key, s] = state.get((key, s), 0) + 1
            stats["aggregator_updates"] += 1
            stats["late_but_accepted"] += end <= wm
            if (key, s) in fired:
                stats["revisions"] += 1
                out.append((key, s, state[key, s], wm, True, seq))
        for key_, s in sorted(state, key=lambda x: (x[1], x[0])):
            if (key_, s) not in fired and s + size <= wm:
                fired.add((key_, s))
                stats["windows_fired"] += 1
                out.append((key_, s, state[key_, s], wm, False, seq))
        if ttl is not None and wm - ttl >= 0:
            gone = [i for i, x in seen.items() if x < wm - ttl]
            stats["dedup_expired"] += len(gone)
            for i in gone:
                del seen[i]
        for k in [k for k in state if k[1] + size + lateness <= wm]:
            del state[k]
        stats["peak_state_entries"] = max(stats["peak_state_entries"], len(state))
    for key, s in sorted(state):
        if (key, s) not in fired:
            stats["windows_fired"] += 1
            out.append((key, s, state[key, s], wm, False, None))
    return {"results": out, "side": side, "stats": stats}


def sessions(rows: list[tuple], gap: int, lag: int, lateness: int = 0, ttl: int | None = None) -> dict:
    """rows as in :func:`policy`. Every arrival goes through all keys' sessions; results carry what they replace."""
    seen: dict = {}
    held: dict = {}  # key -> list of [start, end, count, result is out, replaces]
    fired: set = set()
    wm, latest, peak = -1, None, 0
    out, side = [], []
    for seq, (t, key, ident, _) in enumerate(rows, 1):
        if ttl is not None and ident is not None:
            if ident in seen:
                continue
            seen[ident] = t
        latest = t if latest is None else max(latest, t)
        wm = max(wm, latest - lag)
        own = held.setdefault(key, [])
        touched = [s for s in own if s[0] <= t + gap and t <= s[1]]
        new = [min([t, *(s[0] for s in touched)]), max([t + gap, *(s[1] for s in touched)]), 1 + sum(s[2] for s in touched), False, []]
        if not touched and (key, new[0], new[1]) in fired:
            side.append((seq, key, new[0]))
        else:
            for s in touched:
                new[4] += [(s[0], s[1])] if s[3] else s[4]
                fired.discard((key, s[0], s[1]))
                own.remove(s)
            own.append(new)
        for k in sorted(held):
            for s in held[k]:
                if not s[3] and s[1] <= wm:
                    s[3] = True
                    fired.add((k, s[0], s[1]))
                    out.append((k, s[0], s[1], s[2], wm, bool(s[4]), seq, sorted(s[4])))
            held[k] = [s for s in held[k] if s[1] + lateness > wm]
        if ttl is not None and wm - ttl >= 0:
            seen = {i: x for i, x in seen.items() if x >= wm - ttl}
        peak = max(peak, sum(map(len, held.values())))
    out += [(k, s[0], s[1], s[2], wm, bool(s[4]), None, sorted(s[4])) for k in held for s in held[k] if not s[3]]
    return {"results": out, "side": side, "peak": peak}
