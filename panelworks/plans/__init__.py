"""The registered queries over the test tables, and their SQL."""

from panelworks.plans import audits, evaluation, flows, forecasts, jobs, keyed, panel, rasters, scores, space  # noqa: F401
from panelworks.plans.base import QUERIES, SQL  # noqa: F401
