"""Declared schemas of the engine's tables and a check for required columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SAMPLE = T.StructType([T.StructField("name", T.StringType()), T.StructField("filepath", T.StringType()), T.StructField("original_path", T.StringType())])
CONTOUR_SAMPLE = T.StructType([T.StructField("individual", T.StringType()), T.StructField("filepath", T.StringType()), T.StructField("view", T.StringType())])
ARCHIVE_SAMPLE = T.StructType([T.StructField("name", T.StringType()), T.StructField("filepath", T.StringType()), T.StructField("data_source", T.StringType())])

POINT = "struct<x:double,y:double>"
CONTOUR_CACHE = "struct<contours:array<array<array<int>>>,views:array<string>>"
FACE_CACHE = "struct<predictions:array<struct<x:double,y:double,width:double,height:double,confidence:double>>>"
MASK_CACHE = "struct<crop_bbox:struct<x_min:int,y_min:int,x_max:int,y_max:int>,image_size:struct<width:int,height:int>,sam_body:struct<predictions:array<struct<rle_mask:string>>>,sam_tusk:struct<predictions:array<struct<rle_mask:string>>>>"
POINT_PREDICTIONS = f"struct<predictions:array<struct<points:array<{POINT}>,keypoints:array<{POINT}>,confidence:double>>>"
COCO_IMAGE = "struct<id:bigint,file_name:string,height:int,width:int>"
COCO_ANNOTATION = "struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,segmentation:array<array<double>>,iscrowd:int,keypoints:array<double>>"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df
