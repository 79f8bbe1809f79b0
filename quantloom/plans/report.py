"""Text of the coverage report."""

from __future__ import annotations


def coverage_text(rows: list[dict], moves: list[dict] = ()) -> str:
    """Fixed-width table of coverage rows, short histories marked, and the large moves below."""
    lines = [f"{'ticker':<16}{'bars':>8}  {'first':<12}{'last':<12}{'span %':>8}{'asked %':>9}"]
    for r in rows:
        mark = " short" if r["short_history"] else ""
        lines.append(f"{r['ticker']:<16}{r['bars']:>8}  {str(r['first_date'] or '-'):<12}{str(r['last_date'] or '-'):<12}{r['pct_of_span']:>8.1f}{r['pct_of_requested']:>9.1f}{mark}")
    lines += [f"{m['ticker']:<16}{m['date']}  {100 * m['ret']:+.1f} %  {m['status']}" for m in moves]
    return "\n".join(lines)
