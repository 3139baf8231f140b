"""Session scope as data.

A report runs for one session: a role, a tenant (owner) and, for driver
users, the linked driver. Requested driver / car filters come from the
request. Each of these may be a Python int (folded into the plan as a literal,
so the filter reaches the parquet scan) or a Spark ``Column`` such as a scalar
subquery (``df.select(F.min("id")).scalar()``), which keeps the whole job lazy.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

IntLike = Union[int, Column]


def as_col(x: IntLike | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


@dataclass(frozen=True)
class Scope:
    """Who is asking, and for what.

    ``owner_user_id`` is the tenant of the session (a user's owner, or its own
    id when it has none). ``linked_driver_id`` is the driver a driver user is
    linked to (None if unlinked).
    """

    role: str
    owner_user_id: IntLike
    linked_driver_id: IntLike | None = None
    requested_driver_id: IntLike = 0
    requested_car_id: int = 0
    user_id: int | None = None

    @staticmethod
    def admin(owner_user_id: IntLike, driver_id: IntLike = 0, car_id: int = 0,
              user_id: int | None = None) -> "Scope":
        return Scope("admin", owner_user_id, None, driver_id, car_id, user_id)

    @staticmethod
    def driver_user(linked_driver_id: IntLike | None, owner_user_id: IntLike = 0,
                    car_id: int = 0, user_id: int | None = None) -> "Scope":
        return Scope("driver", owner_user_id, linked_driver_id, 0, car_id, user_id)

    @property
    def is_admin(self) -> bool:
        return self.role == "admin"

    @property
    def is_driver_user(self) -> bool:
        return self.role == "driver"

    def resolved_driver(self) -> IntLike:
        """Driver filter after the session override.

        A driver user always gets its own driver, or -1 when unlinked (which
        later yields no rows); anyone else gets the requested driver. A falsy
        id means "all drivers" (0).
        """
        if self.is_driver_user:
            d = self.linked_driver_id
            if d is None:
                return -1
            if isinstance(d, Column):
                return F.coalesce(d, F.lit(-1))
            return d if d else -1
        d = self.requested_driver_id
        if isinstance(d, Column):
            return F.coalesce(d, F.lit(0))
        return d or 0

    def resolved_car(self) -> int:
        return self.requested_car_id if self.requested_car_id > 0 else 0

    def show_fleet(self) -> bool | Column:
        """Fleet totals are shown to an admin with no driver and no car selected."""
        if not self.is_admin or self.resolved_car() != 0:
            return False
        d = self.resolved_driver()
        if isinstance(d, Column):
            return d == 0
        return d == 0
