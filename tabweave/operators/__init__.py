"""DataFrame operators.

``fit`` functions run jobs and return small fitted values or written tables; everything
else returns a lazy DataFrame.
"""
