"""A small engine for batch data on Spark: named datasets, groups, joins, sorts and the functions that go with them."""

from .functions.group_functions import Aggregate, Avg, Concat, Counts, Extend, GroupRows, Max, Median, Min, Rows, Sort, Sum, Top, Unique, UniqueCounts
from .operators.job_control import counted, run, settings
from .operators.jobs import equal, group, inner_join, left_outer_join, list_columns, named, right_outer_join, sort
from .sources.dataset import ColumnRef, Dataset, from_dataframe
from .sources.readers import delimited, read, register, sequence_file, typed
from .sources.sinks import save, save_text

__all__ = [
    "Aggregate", "Avg", "ColumnRef", "Concat", "Counts", "Dataset", "Extend", "GroupRows", "Max", "Median", "Min", "Rows", "Sort", "Sum", "Top", "Unique", "UniqueCounts",
    "counted", "delimited", "equal", "from_dataframe", "group", "inner_join", "left_outer_join", "list_columns", "named", "read", "register", "right_outer_join", "run", "save", "save_text", "sequence_file", "settings", "sort", "typed",
]
