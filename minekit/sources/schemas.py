"""Column layouts of the programs' input files. All of these are fixed values."""

from __future__ import annotations

RATINGS = "userId long, movieId long, rating float, timestamp long"

TRIPS = """
passenger_count int, trip_duration int, day_of_week int, timeOfDay int, dist_in_km int,
rain_stat int, snow_stat int, duration_bin int
"""
TRIP_FEATURES = "passenger_count day_of_week timeOfDay dist_in_km rain_stat snow_stat".split()
# a prefix of the classified trips
SEGMENT = """
passenger_count int, day_of_week int, timeOfDay int, dist_in_km int, rain_stat int,
snow_stat int, trip_duration int
"""

POSTS = """
external_author_id string, author string, content string, region string, language string,
publish_date string, harvested_date string, following string, followers string, updates string,
post_type string, account_type string, new_june_2018 string, retweet string, account_category string
"""
DOCUMENTS = "id long, value string"

LABELS = "parcelid long, logerror double, transactiondate string"

# column: type, value for missing cells, name in the training table
_HOUSING = """
parcelid                      bigint  -               id_parcel
assessmentyear                int     2015            tax_year
bathroomcnt                   int     2.0             num_bathroom
bedroomcnt                    int     3.0             num_bedroom
buildingqualitytypeid         int     7               quality
calculatedbathnbr             int     2.0             num_bathroom_calc
calculatedfinishedsquarefeet  int     1440.0          area_total_calc
censustractandblock           bigint  60379203391054  census
finishedsquarefeet12          int     1440            area_live_finished
fips                          int     06037           no_fip
fullbathcnt                   int     2               num_full_bath
heatingorsystemtypeid         int     2               heating
landtaxvaluedollarcnt         double  20980.0         tax_land
latitude                      int     33984600        latitude
longitude                     int     -118390000      longitude
lotsizesquarefeet             int     6000.0          area_lot
propertylandusetypeid         int     261             zoning_landuse
rawcensustractandblock        double  060590524.262052  rawcensus
regionidcity                  int     12447           region_city
regionidcounty                int     3101            region_county
regionidzip                   int     96987           region_zip
structuretaxvaluedollarcnt    int     100000.0        tax_building
taxamount                     double  345.72          tax_property
taxvaluedollarcnt             int     400000.0        tax_total
unitcnt                       int     1               num_unit
yearbuilt                     int     1955.0          build_year
"""
_ROWS = [line.split() for line in _HOUSING.strip().splitlines()]

HOUSING_TYPES = {column: kind for column, kind, _, _ in _ROWS}
HOUSING_FILLS = {column: fill for column, _, fill, _ in _ROWS if fill != "-"}
HOUSING_NAMES = [name for _, _, _, name in _ROWS]
HOUSING_FEATURES = HOUSING_NAMES[1:]
HOUSING_LABEL = "logerror"

SCORING = ", ".join(
    f"{name} {'double' if kind == 'double' else 'long'}" for _, kind, _, name in _ROWS
)
TRAINING = f"{SCORING}, {HOUSING_LABEL} double"
