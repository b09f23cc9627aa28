"""Minimum-cost flow on the few shards of a layout, by successive cheapest paths."""

from __future__ import annotations

from collections.abc import Callable, Sequence


def cheapest_transfers(
    supply: Sequence[int], room: Sequence[int], cost: Callable[[int, int], int]
) -> dict[tuple[int, int], int]:
    """Amounts from each supply i to each room j that place all supply at least total cost.

    ``cost(i, j)`` is per unit and not negative. The graph has a node per
    supply and per room; every augmentation empties a supply, fills a room or
    uses up what another path had placed.
    """
    if sum(supply) > sum(room):
        raise ValueError("the rooms do not hold the supply")
    n, m = len(supply), len(room)
    flow = [[0] * m for _ in range(n)]
    left, free = list(supply), list(room)
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    for source in range(n):
        while left[source]:
            # Bellman-Ford over supplies and rooms; a placed unit can be taken back at its negative price.
            far = float("inf")
            to_supply, to_room = [far] * n, [far] * m
            from_room, from_supply = [None] * n, [None] * m
            to_supply[source] = 0
            changed = True
            while changed:
                changed = False
                for i in range(n):
                    if to_supply[i] < far:
                        for j in range(m):
                            if to_supply[i] + price[i][j] < to_room[j]:
                                to_room[j], from_supply[j], changed = to_supply[i] + price[i][j], i, True
                for j in range(m):
                    if to_room[j] < far:
                        for i in range(n):
                            if flow[i][j] and to_room[j] - price[i][j] < to_supply[i]:
                                to_supply[i], from_room[i], changed = to_room[j] - price[i][j], j, True
            end = min((j for j in range(m) if free[j]), key=lambda j: (to_room[j], j))
            path, j = [], end
            while True:
                i = from_supply[j]
                path.append((i, j, 1))
                if i == source:
                    break
                j = from_room[i]
                path.append((i, j, -1))
            amount = min([left[source], free[end], *(flow[i][j] for i, j, way in path if way < 0)])
            for i, j, way in path:
                flow[i][j] += way * amount
            left[source] -= amount
            free[end] -= amount
    return {(i, j): flow[i][j] for i in range(n) for j in range(m) if flow[i][j]}
