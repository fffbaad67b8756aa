"""Where the given tables lie (a module of its own: several folders hold a ``conftest``)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"
