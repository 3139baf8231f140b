"""fleetbook: fleet-accounting analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame(s) + parameters -> DataFrame``.
No operator collects data to the driver; parameters that come from a
request (owner, driver, period) are either Python scalars, resolved before
planning, or Spark ``Column`` expressions (scalar subqueries), so that a
whole report stays one lazy plan that Catalyst can optimise.
"""

from fleetbook.scope import Scope
from fleetbook.session import build_session, checkpoint_dir

__all__ = ["Scope", "build_session", "checkpoint_dir"]
__version__ = "0.1.0"
