"""The order-dependent merge rule of the flow cache, shared by the batch and the streaming profile builder.

An open flow is a short list; all sums are kept per canonical direction (``swap`` False / True).
"""

START, END, SWAP, P0, B0, P1, B1, REVERSED = range(8)


def open_flow(start, end, swap, packets, octets) -> list:
    sums = [0, 0, packets, octets] if swap else [packets, octets, 0, 0]
    return [start, end, swap, *sums, False]


def _accepts(flow: list, start: int, end: int, swap: bool, packets: int, inactive: int, active: int) -> bool:
    gap_after = flow[END] + inactive < start
    if not flow[REVERSED] and swap != flow[SWAP] and not gap_after and end + inactive >= flow[START]:
        return True  # the first record of the opposite direction
    if packets == 1 and abs(start - flow[END]) < inactive:
        return True  # exported early by the probe
    if flow[END] - flow[START] < active - inactive:
        return False  # too short to have been cut by the active timeout
    return not gap_after


def absorb(flow: list, start: int, end: int, swap: bool, packets: int, octets: int, inactive: int, active: int) -> bool:
    """Merge a record into the open flow if the rules allow it."""
    if not _accepts(flow, start, end, swap, packets, inactive, active):
        return False
    flow[START], flow[END] = min(flow[START], start), max(flow[END], end)
    at = P1 if swap else P0
    flow[at] += packets
    flow[at + 1] += octets
    flow[REVERSED] = flow[REVERSED] or (swap != flow[SWAP] and packets > 0)
    return True


def decision_state(flow: list, inactive: int, active: int) -> tuple:
    """What later decisions depend on. A flow that outlived ``active - inactive`` only asks for its end."""
    if flow[END] - flow[START] >= active - inactive:
        return (True, None, flow[END], None, None)
    return (False, flow[START], flow[END], flow[SWAP], flow[REVERSED])


def resume(long: bool, start, end: int, swap, reversed_, inactive: int, active: int) -> list:
    """An open flow without sums that decides like the one the state was taken from."""
    if long:
        return [end - (active - inactive), end, False, 0, 0, 0, 0, True]
    return [start, end, bool(swap), 0, 0, 0, 0, bool(reversed_)]
