"""Operations of a training-data pipeline, each a Spark job over whole tables.

Nothing outside this folder imports it. Operators live in one module each;
``queries`` binds them to the driver's tables.
"""
