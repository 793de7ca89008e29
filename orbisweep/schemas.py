"""Row shapes shared by the readers, operators and writers."""

STATE = ["x", "y", "z", "vx", "vy", "vz"]
STATE_DDL = "x double, y double, z double, vx double, vy double, vz double"

OBJECTS_DDL = (
    "idx bigint, id bigint, name string, country string, rcs string, type string, "
    + STATE_DDL
    + ", alive boolean, size_m double, mass_kg double, area_to_mass double, event bigint"
)
OBJECT_COLUMNS = [part.strip().split(" ")[0] for part in OBJECTS_DDL.split(",")]

SNAPSHOT_DDL = (
    "id bigint, x_km double, y_km double, z_km double, "
    "vx double, vy double, vz double, alive int"
)
TRAJECTORY_DDL = "t_s double, id bigint, name string, x_km double, y_km double, z_km double"
MOON_DDL = "t_s double, x_km double, y_km double, z_km double"
MASS_DDL = "rcs string, type string, mass_kg double"
GP_DDL = (
    "NORAD_CAT_ID string, EPOCH string, OBJECT_NAME string, TLE_LINE1 string, "
    "TLE_LINE2 string, INCLINATION string, PERIOD string"
)
SATCAT_DDL = (
    "NORAD_CAT_ID string, OBJECT_TYPE string, RCS_SIZE string, RCSVALUE string, "
    "OBJECT_ID string, COUNTRY string"
)
